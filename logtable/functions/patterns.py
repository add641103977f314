"""Filter patterns: RE2 syntax in, the same language as a Java pattern out.

Users write filters in RE2 syntax; ``rlike`` runs Java patterns. The two agree
on most constructs. This module rewrites the ones that differ and refuses what
RE2 refuses (look-around, back-references, stacked repetition).

Java matches a repeated group by calling itself for every round, so a long cell can exhaust
its stack and end the JVM. A repeated single character is a loop there. So alternatives of one
character each become a class, ``x{n,}`` becomes ``x{n}x*``, and a pattern that still repeats a
group is told by :func:`repeats_group`: it must not run in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class InvalidPattern(ValueError):
    """The filter pattern is not valid; the previous filter stays in force."""


# RE2 named classes and Perl classes as members of a Java class.
NAMED_CLASS = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F",
    "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": r"\x21-\x7E", "lower": "a-z", "print": r"\x20-\x7E",
    "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
PERL_CLASS = {"d": "0-9", "s": r"\t\n\f\r\x20", "w": "0-9A-Za-z_"}
CONTROL = {"a": r"\x07", "f": r"\f", "n": r"\n", "r": r"\r", "t": r"\t", "v": r"\x0B"}

WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
# Beside what is a word character for sure, one look-around tells a word edge.
BEFORE_WORD, AFTER_WORD = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
WORD_NEXT = re.compile(r"(?:\\[dw]|\w)(?![*?]|\{0)", re.ASCII)
# Ignoring case, K and S also stand for letters that are no word characters.
FOLDED_WORD_NEXT = re.compile(r"(?:\\d|(?![kKsS])\w)(?![*?]|\{0)", re.ASCII)
MAY_BE_NONE = re.compile(r"[*?]|\{0")
GROUP_NAME = re.compile(r"\\Q.*?(?:\\E|\Z)|\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]|(\(\?<)", re.S)
REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
MAX_REPEAT = 1000
# A bound on the nodes that Java goes through, one inside the other, for a repeated group.
MOST_NODES = 2000
# What is written for one character, and may stand in a class: a hexadecimal one, a letter or
# digit, or a class.
ONE_CHARACTER = re.compile(r"\\x[0-9A-F]{2}|[^\\^$.|?*+(){}\[\]&-]|\[[^\[\]]*\]")


@dataclass(frozen=True)
class _Flags:
    fold: bool = False
    multi: bool = False
    dot_all: bool = False
    lazy: bool = False

    def changed(self, text: str) -> _Flags:
        names = {"i": "fold", "m": "multi", "s": "dot_all", "U": "lazy"}
        on, minus, off = text.partition("-")
        if (minus and not off) or any(ch not in names for ch in on + off):
            raise InvalidPattern(f"unknown flags {text!r}")
        values = {names[ch]: True for ch in on} | {names[ch]: False for ch in off}
        return _Flags(**{**self.__dict__, **values})


def literal(text: str) -> str:
    """A Java pattern that matches ``text`` itself."""
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else f"\\x{ord(ch):02X}" for ch in text)


class _Translation:
    def __init__(self, pattern: str):
        self.src, self.at, self.out = pattern, 0, []
        # Whether what was read last ends in a word character for sure; texts that every
        # match holds.
        self.word, self.needed = False, [""]
        # Whether a group is repeated; where the last atom begins in ``out``; and, if the last
        # group is one character, its opening and the class that it is.
        self.repeats_group, self.last, self.single = False, 0, None

    def fail(self, why: str):
        raise InvalidPattern(f"{why} in pattern {self.src!r}")

    def take(self, text: str) -> bool:
        if self.src.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def run(self) -> str:
        try:
            self.alternatives(_Flags(), depth=0)
        except IndexError:
            self.fail("unexpected end")
        if self.at < len(self.src):
            self.fail("unexpected )")
        return "".join(self.out)

    def alternatives(self, flags: _Flags, depth: int):
        self.word = several = False
        flags = self.branch(flags, depth)
        while self.take("|"):
            self.out.append("|")
            self.word, several = False, True
            flags = self.branch(flags, depth)
        if several:
            self.word = False
            if not depth:
                self.needed = [""]

    def must_hold(self, text: str, depth: int, flags: _Flags):
        """Note a literal outside groups, or ('') something else."""
        if depth or flags.fold or not text:
            self.needed.append("")
        else:
            self.needed[-1] += text

    def branch(self, flags: _Flags, depth: int) -> _Flags:
        """One alternative; flags that it changes stay so in the next."""
        repeatable = False
        while self.at < len(self.src):
            ch = self.src[self.at]
            if ch in "|)":
                break
            count = self.repetition()
            if count is not None:
                if not repeatable:
                    self.fail("misplaced repetition")
                self.repeat(count, "" if self.take("?") == flags.lazy else "?")
                if MAY_BE_NONE.match(count):
                    self.word, self.needed[-1] = False, self.needed[-1][:-1]
                self.needed.append("")
                if self.at < len(self.src) and self.repetition(peek=True):
                    self.fail("stacked repetition")
                repeatable = False
                continue
            repeatable, self.last, self.single = True, len(self.out), None
            if self.take("("):
                self.must_hold("", depth, flags)
                flags, repeatable = self.group(flags, depth)
                continue
            word, self.word = self.word, False
            if ch == "\\":
                self.escape(flags, depth, word)
                continue
            if ch not in "[.^$":
                self.at += 1
                self.out.append(literal(ch))
                self.must_hold(ch, depth, flags)
                self.word = self.is_word(ch, flags)
                continue
            self.must_hold("", depth, flags)
            if ch == "[":
                self.out.append(self.char_class())
            elif self.take("."):
                self.out.append("(?s:.)" if flags.dot_all else r"[^\n]")
            elif self.take("^"):
                self.out.append(r"(?<![^\n])" if flags.multi else r"\A")
            elif self.take("$"):
                self.out.append(r"(?![^\n])" if flags.multi else r"\z")
        return flags

    def repeat(self, count: str, lazy: str):
        """Repeat the last atom."""
        atom = "".join(self.out[self.last:])
        del self.out[self.last:]
        opening, closing = "", ""
        if self.single:
            opening, atom = self.single
            closing = ")"
        elif atom.startswith(("(?iu:", "(?-iu:")) and not self.few_rounds(count, atom):
            self.repeats_group = True
        if count[0] == "{" and count.endswith(",}"):
            count = f"{count[:-2]}}}{atom}*"
        self.out.append(f"{opening}{atom}{count}{lazy}{closing}")
        self.single = None

    @staticmethod
    def few_rounds(count: str, group: str) -> bool:
        """Whether a group is repeated so rarely that its rounds need little stack."""
        low, high = REPEAT.fullmatch(count).groups() if count[0] == "{" else (0, "1" if count == "?" else "")
        most = low if high is None else high
        return most != "" and int(most) * len(group) <= MOST_NODES and "){" not in group

    @staticmethod
    def is_word(ch: str, flags: _Flags) -> bool:
        return ch.isascii() and (ch.isalnum() or ch == "_") and not (flags.fold and ch in "kKsS")

    def repetition(self, peek: bool = False) -> str | None:
        ch = self.src[self.at]
        if ch in "*+?":
            size, text = 1, ch
        elif ch == "{" and (found := REPEAT.match(self.src, self.at)):
            low, high = int(found[1]), found[2]
            if max(low, int(high or 0)) > MAX_REPEAT or (high and int(high) < low):
                self.fail("bad repetition count")
            size, text = len(found[0]), found[0]
        else:
            return None
        if not peek:
            self.at += size
        return text

    def group(self, flags: _Flags, depth: int) -> tuple[_Flags, bool]:
        """A group or a flag change; capturing is of no use to a yes/no match."""
        inner = flags
        if self.take("?"):
            if self.take("P<") or (self.src[self.at] == "<" and self.src[self.at + 1] not in "=!"):
                self.take("<")
                name, _, _ = self.src[self.at:].partition(">")
                if not re.fullmatch(r"\w+", name) or ">" not in self.src[self.at:]:
                    self.fail("bad group name")
                self.at += len(name) + 1
            else:
                end = re.compile(r"[^:)]*").match(self.src, self.at).end()
                text, closing = self.src[self.at:end], self.src[end]
                self.at = end + 1
                inner = flags.changed(text)
                if closing == ")":
                    if not text:
                        self.fail("missing flags")
                    self.out.append("(?iu)" if inner.fold else "(?-iu)")
                    self.word = False
                    return inner, False
        begin, opening = len(self.out), "(?iu:" if inner.fold else "(?-iu:"
        self.out.append(opening)
        self.alternatives(inner, depth + 1)
        if not self.take(")"):
            self.fail("missing )")
        inside = self.out[begin + 1 :]
        self.out.append(")")
        self.last = begin
        # Atoms of one character stand alone in ``out``, between bars.
        atoms, bars = inside[::2], inside[1::2]
        one = len(inside) % 2 and all(map(ONE_CHARACTER.fullmatch, atoms)) and set(bars) <= {"|"}
        self.single = (opening, f"[{''.join(atoms)}]") if one else None
        return flags, True

    def escape(self, flags: _Flags, depth: int, word: bool):
        """``word``: what stands before ends in a word character."""
        if self.take("\\Q"):
            self.must_hold("", depth, flags)
            quoted_text, _, _ = self.src[self.at:].partition("\\E")
            self.at = min(len(self.src), self.at + len(quoted_text) + 2)
            self.out.extend(map(literal, quoted_text))
            self.last = max(self.last, len(self.out) - 1)
            return
        ends = {"A": r"\A", "z": r"\z", "b": WORD_EDGE, "B": NO_WORD_EDGE}
        kind = self.src[self.at + 1]
        if kind in ends:
            self.must_hold("", depth, flags)
            self.at += 2
            edge = ends[kind]
            if kind == "b" and word:
                edge = AFTER_WORD
            elif kind == "b" and (FOLDED_WORD_NEXT if flags.fold else WORD_NEXT).match(self.src, self.at):
                edge = BEFORE_WORD
            self.out.append(edge)
            return
        member = self.class_escape()
        self.must_hold(kind if not kind.isalnum() else "", depth, flags)
        self.word = kind == "d" or (kind == "w" and not flags.fold)
        self.out.append(f"[{member}]" if member[0] != "[" else member)

    def class_escape(self) -> str:
        """One escape as a class member: used inside and outside brackets."""
        ch = self.src[self.at + 1]
        self.at += 2
        if ch.lower() in PERL_CLASS:
            members = PERL_CLASS[ch.lower()]
            return members if ch.islower() else f"[^{members}]"
        if ch in CONTROL:
            return CONTROL[ch]
        if ch in "pP":
            if self.take("{"):
                name, _, _ = self.src[self.at:].partition("}")
                self.at += len(name) + 1
            else:
                name, self.at = self.src[self.at], self.at + 1
            negated = (ch == "P") != name.startswith("^")
            name = name.lstrip("^")
            java = name if len(name) <= 2 else f"Is{name}"
            if not re.fullmatch(r"\w+", name):
                self.fail("bad Unicode class")
            return rf"\{'P' if negated else 'p'}{{{java}}}" if name != "Any" else r"\x{0}-\x{10FFFF}"
        if ch == "x":
            found = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})").match(self.src, self.at)
            if not found or (code := int(found[1] or found[2], 16)) > 0x10FFFF:
                self.fail("bad hex escape")
            self.at = found.end()
            return rf"\x{{{code:X}}}"
        if ch in "01234567":
            found = re.compile(r"0[0-7]{0,2}|[1-7][0-7]{1,2}").match(self.src, self.at - 1)
            if not found:
                self.fail("back-reference")
            self.at = found.end()
            return rf"\x{{{int(found[0], 8):X}}}"
        if ord(ch) > 127 or ch.isalnum():
            self.fail(f"unknown escape \\{ch}")
        return literal(ch)

    def char_class(self) -> str:
        self.at += 1
        negated = self.take("^")
        members, first = [], True
        while first or self.src[self.at] != "]":
            first = False
            named = re.compile(r"\[:(\^?)(\w+):\]").match(self.src, self.at)
            if named:
                if named[2] not in NAMED_CLASS:
                    self.fail("unknown named class")
                self.at = named.end()
                text = NAMED_CLASS[named[2]]
                members.append(f"[^{text}]" if named[1] else text)
                continue
            low, single = self.class_member()
            if single and self.src[self.at] == "-" and self.src[self.at + 1] != "]":
                self.at += 1
                high, high_single = self.class_member()
                if not high_single:
                    self.fail("bad class range")
                members.append(f"{low}-{high}")
            else:
                members.append(low)
        self.at += 1
        return f"[{'^' if negated else ''}{''.join(members)}]"

    def class_member(self) -> tuple[str, bool]:
        if self.src[self.at] == "\\":
            kind = self.src[self.at + 1]
            return self.class_escape(), kind not in "pPdDsSwW"
        self.at += 1
        return literal(self.src[self.at - 1]), True


def to_java(pattern: str) -> str:
    """Translate an RE2 pattern; raises :class:`InvalidPattern`."""
    return _Translation(pattern).run()


def repeats_group(pattern: str) -> bool:
    """Whether the Java pattern repeats a group, so that long cells may exhaust its stack."""
    read = _Translation(pattern)
    read.run()
    return read.repeats_group


def to_re2(pattern: str) -> str:
    """The pattern for RE2 itself: only older names of groups are known everywhere."""
    to_java(pattern)
    return GROUP_NAME.sub(lambda m: m[0] if m[1] is None else "(?P<", pattern)


def needed_text(pattern: str) -> str:
    """A text that every match of the pattern holds, '' if none is known."""
    read = _Translation(pattern)
    read.run()
    return max(read.needed, key=len)
