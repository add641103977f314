"""Token files: exact round trips, their order, and reading single documents."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from logtable.llm import token_files as module
from logtable.llm.queries import tokenizer_path
from logtable.llm.token_files import SEPARATOR, Record, fresh_folder, read_ids, record, write_ids
from tests.llm.conftest import ODD


def whole_ids(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def expected(rows):
    encoded = [(i, whole_ids(text)) for i, text, _ in rows]
    encoded.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    out, start = [], 0
    for i, ids in encoded:
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, path, only=None):
    rows = read_ids(spark, path, only).collect()
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])


def test_round_trip_of_odd_documents(spark, odd):
    path = fresh_folder(spark)
    write_ids(odd, path, tokenizer_path())
    assert read(spark, path) == expected(ODD)


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_many_records_parts_and_files(spark, docs, monkeypatch, size):
    monkeypatch.setattr(module, "RECORD_BYTES", size)
    rows = [(i * 7 % 200 - 50, f"text {i} of many " * (i % 9), "a") for i in range(200)]
    path = fresh_folder(spark)
    write_ids(docs(rows), path, tokenizer_path())
    want = expected(rows)
    assert read(spark, path) == want
    assert read(spark, path, [3, 100, 9999]) == [r for r in want if r[0] in (3, 100)]


def test_documents_stand_in_order_in_the_files(spark, docs):
    path = fresh_folder(spark)
    write_ids(docs([(i, f"number {i}", "a") for i in (5, 3, 9, 1, 7)]), path, tokenizer_path())
    found = [Record.of(bytes(row["record"])) for row in module._records(spark, path).collect()]
    assert [i for r in sorted(found, key=lambda r: (r.part, r.number)) for i in r.ids] == [1, 3, 5, 7, 9]


def test_one_id_in_most_rows_and_an_empty_table(spark, docs, none):
    rows = [(4, "same words here", "a")] * 60 + [(2, "other", "a"), (None, "", "a")]
    path = fresh_folder(spark)
    write_ids(docs(rows), path, tokenizer_path())
    assert read(spark, path) == expected(rows)
    path = fresh_folder(spark)
    write_ids(none, path, tokenizer_path())
    assert read(spark, path) == []


def test_another_dictionary_is_refused(spark, docs):
    path = fresh_folder(spark)
    write_ids(docs([(i, f"the words of text {i} " * 40, "a") for i in range(50)]), path, tokenizer_path())
    spark.createDataFrame([(b"another dictionary",)], "value binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_ids(spark, path).collect()


def test_records_hold_any_bytes():
    frames = [b"\n\xff\x00", b"", SEPARATOR.encode() * 5]
    made = record(b"d" * 32, 3, 1, 10, 2, [5, None, -7], [4, 1, 2], frames)
    one = Record.of(made)
    assert SEPARATOR.encode() not in made
    assert (one.part, one.number, one.start, one.ids, one.before.tolist()) == (3, 1, 10, [5, None, -7], [0, 4, 5, 7])
    assert [bytes(one.frames[int(a):int(b)]) for a, b in zip(one.places[:-1], one.places[1:])] == frames
    with pytest.raises(ValueError, match="cut short"):
        Record.of(made[:-1])


def test_separators_and_line_ends_come_back_from_files(spark):
    path, rows = fresh_folder(spark), []
    for i in range(300):
        frames = [b"\n" * (i % 7) + SEPARATOR.encode()[: i % 20], bytes([i % 256]) * 70_000]
        rows.append((bytearray(record(b"d" * 32, i, 0, 0, 2, [i, i], [1, 1], frames)),))
    values = spark.createDataFrame(rows, "value binary").repartition(2).selectExpr("cast(value AS string) value")
    values.write.option("lineSep", SEPARATOR).text(f"{path}/ids")
    assert sorted(bytes(r["record"]) for r in module._records(spark, path).collect()) == sorted(bytes(r[0]) for r in rows)
