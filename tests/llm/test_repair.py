"""Conversation repair against an exhaustive search, and its trails under colliding hashes."""

import hashlib
import itertools
import random
import re

import pytest

from logtable.llm import repair as module
from logtable.llm.repair import FAULTS, pieces, repair, replay, ways
from logtable.llm.trails import Step, Trails, cheapest

SCHEMA = "conv_id long, turn long, role string, text string"
VALID = re.compile(r"(s?(ua)+)?\Z")


def every_repair(rows):
    """(cost, audit, turns) of all edits of ``rows`` (role, text, fault) with at most two inserts a gap."""
    def choices(row):
        role, text, fault = row
        yield 4, "D", []
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            yield more, "K", [(role, text)]
            yield more + 3, "R", [("user", text)]
            yield more + 3, "R", [("assistant", text)]

    inserts = [(3 * n, "I" * n, [(r, "") for r in roles])
               for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    slots = [inserts]
    for row in rows:
        slots += [list(choices(row)), inserts]
    for picked in itertools.product(*slots):
        turns = [t for _, _, some in picked for t in some]
        if VALID.match("".join(role[:1] for role, _ in turns)) and all(role for role, _ in turns):
            yield sum(c for c, _, _ in picked), "".join(a for _, a, _ in picked), turns


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(rows):
    return min(every_repair(faults(rows)), key=lambda found: found[:2])


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def random_rows(seed, conversations, most):
    pick = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "sam", "User", ""], ["a.", "b", " ", "c!", "d ?\n", "", "x\x85"]
    return {
        conv: [(pick.choice(roles[:3] if pick.random() < 0.8 else roles), pick.choice(texts)) for _ in range(pick.randint(1, most))]
        for conv in range(conversations)}


def as_frame(spark, rows):
    flat = [(conv, i, role, text) for conv, some in rows.items() for i, (role, text) in enumerate(some)]
    random.Random(5).shuffle(flat)
    return spark.createDataFrame(flat, SCHEMA).repartition(3)


def found(spark, rows):
    out = repair(as_frame(spark, rows))
    digests = {r["conv_id"]: r["digest"] for r in out.turns.collect() if r["digest"]}
    return {r["conv_id"]: (r["cost"], r["audit"], digests.get(r["conv_id"], digest([]))) for r in out.conversations.collect()}


@pytest.mark.parametrize("run", [1, 2, 4096])
def test_cheapest_repairs_against_all_repairs(spark, monkeypatch, run):
    monkeypatch.setattr(module, "RUN", run)
    rows = random_rows(run, 60, 3)
    want = {conv: expected(some) for conv, some in rows.items()}
    assert found(spark, rows) == {conv: (cost, audit, digest(turns)) for conv, (cost, audit, turns) in want.items()}


def test_long_conversation_in_runs_is_the_same_as_in_one(spark, monkeypatch):
    rows = random_rows(9, 3, 2) | {77: [row for some in random_rows(3, 150, 8).values() for row in some]}
    whole = found(spark, rows)
    monkeypatch.setattr(module, "RUN", 16)
    assert found(spark, rows) == whole
    turns = [r for r in repair(as_frame(spark, rows)).turns.filter("conv_id = 77").orderBy("place").collect()]
    assert VALID.match("".join(r["role"][0] for r in turns[:-1])) and turns[-1]["digest"] == whole[77][2]


def test_faults_gaps_and_illegal_pairs(spark):
    rows = [
        (1, 5, "user", "hi."), (1, 9, "user", "hi."), (1, None, "user", "first"), (1, 9, "assistant", " \n"), (1, 9, None, None),
        (None, None, "assistant", "x."), (3, 2, "", "y."), (3, 2, "", "y."), (4, 0, "user", "q?"), (4, 1, "assistant", "a.")]
    got = {r["conv_id"]: r for r in repair(spark.createDataFrame(rows, SCHEMA)).conversations.collect()}
    assert {c: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) for c, r in got.items()} == {
        1: (3, 2, 1, 1, 3), None: (0, 0, 0, 0, 0), 3: (0, 0, 1, 0, 1), 4: (0, 0, 0, 0, 0)}
    assert (got[4]["cost"], got[4]["audit"]) == (0, "KK") and (got[None]["cost"], got[None]["audit"]) == (3, "IK")


def test_empty_table_and_very_long_texts(spark):
    none = repair(spark.createDataFrame([], SCHEMA))
    assert none.conversations.count() == 0 and none.turns.count() == 0
    long = "word " * 100_000 + "."
    rows = {1: [("user", long), ("assistant", long)], 2: [("user", long)] * 3}
    assert found(spark, rows) == {c: (cost, a, digest(t)) for c, some in rows.items() for cost, a, t in [expected(some)]}


def test_clashing_columns(spark):
    frame = as_frame(spark, {1: [("user", "a."), ("assistant", "b.")]}).selectExpr(
        "*", *[f"'z' AS `{c}`" for c in ("at", "run", "letters", "fault", "said", "head", "state", "end", "of", "cost")])
    assert repair(frame).conversations.first()["audit"] == "KK"


@pytest.mark.parametrize("modulus", [1, 2, 3, 7, (1 << 61) - 1])
def test_colliding_hashes_do_not_change_paths(modulus):
    pick = random.Random(modulus)
    for _ in range(200):
        letters = "".join(chr(65 + pick.randrange(16)) for _ in range(pick.randint(1, 40)))
        steps = [ways(letter) for letter in letters]
        trails, plain = Trails(modulus), Trails()
        got = {s: (c, trails.back(n)[0]) for s, (c, n) in cheapest(trails, steps, 0).items()}
        want = {s: (c, plain.back(n)[0]) for s, (c, n) in cheapest(plain, steps, 0).items()}
        # The same by whole label lists instead of linked nodes.
        at = {0: (0, [])}
        for some in steps:
            best = {}
            for w in some:
                if w.old in at:
                    way = (at[w.old][0] + w.cost, at[w.old][1] + [w.label])
                    best[w.new] = min(best.get(w.new, way), way)
            at = best
        assert got == want == at


def test_equal_strings_in_different_nodes_are_the_same():
    trails = Trails(1)
    a, b, c = trails.add(0, 3, 1), trails.add(0, 3, 2), trails.add(0, 4, 2)
    assert trails.same(a, b) and not trails.same(a, c) and trails.less(a, 9, c, 0) and trails.less(a, 1, b, 2)


def test_pieces_replay_to_valid_turns():
    for letters in ("ABAB", "EBJA", "CABBB", "MNOP"):
        for piece in pieces(letters, (0,)):
            assert len(list(replay(letters, piece.audit, 0))) == len(letters)
    assert FAULTS[0] == "" and all(isinstance(w, Step) for w in ways("A"))
