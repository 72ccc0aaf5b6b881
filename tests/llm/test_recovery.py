"""Results stay whole when tasks are cut anew, and users' columns stay theirs."""

import random
from collections import Counter

import pytest

pytest.importorskip("tindera.llm.queries")
from tindera.llm import minhash, packing  # noqa: E402


@pytest.mark.parametrize(("building", "running"), [(2, 9), (9, 2)])
@pytest.mark.parametrize("limit", [packing.BROADCAST_COUNTS, 0])
def test_packing_under_changed_parallelism(spark, tmp_path, building, running, limit):
    """A file scan is cut by the session's parallelism; pieces are numbered in one scan and placed in another."""
    rnd = random.Random(building)
    rows = [(k, rnd.choice([3, 3, 3, 100, 512, 700, 1024]), "mine") for k in range(3000)]
    spark.createDataFrame(rows, "id long, length long, __part string").repartition(4).write.parquet(f"{tmp_path}/pieces")
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, building)
        packed = packing.pack(spark.read.parquet(f"{tmp_path}/pieces"), broadcast_counts=limit)
        spark.conf.set(key, running)
        found = packed.collect()
    finally:
        spark.conf.unset(key)
    assert Counter((r.id, r.length, r["__part"]) for r in found) == Counter(rows)
    used = {}
    for r in found:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024


def test_near_duplicates_leave_user_columns_alone(spark):
    rows = [(1, "a b c d e f", "user", "x"), (2, "a b c d e f", "other", "y"), (3, None, None, "z"), (3, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __KEY_ string")
    left = minhash.drop_duplicates(docs)
    assert left.schema == docs.schema
    assert Counter(map(tuple, left.collect())) == Counter([rows[0], *rows[2:]])


def test_one_class_of_half_the_rows(spark):
    """Equal texts under many ids, rows without words, and rows without a doc_id."""
    rows = [(k, "one text that half of all rows hold, word by word") for k in range(5, 400)] + [(k, f"words of {k} that {k} alone has and {k * 7} too") for k in range(400, 700)]
    rows += [(k, " ") for k in range(700, 800)] + [(None, rows[0][1])] * 3 + [(2, rows[0][1] + " end")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(found) == len(rows)
    want = {k: 2 if k < 400 else k for k, _ in rows if k is not None}
    assert all((r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True)) for r in found)
