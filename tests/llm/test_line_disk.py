"""What line dedup holds on disk: copies of one round of cells, and no files once it is done."""

import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from doppel.checkpoint import checkpoint_dir
from doppel.llm import lines


def _line(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(n))


@pytest.mark.parametrize("chars", [1, 1 << 26])
def test_a_large_group_is_dealt_in_rounds(spark: SparkSession, monkeypatch, chars):
    """Copies of a group grow with its square, those of a round in proportion to it; no link is lost between rounds."""
    monkeypatch.setattr(lines, "BLOCK", 16)
    monkeypatch.setattr(lines, "DEALT_CHARS", chars)
    moved, write = [], lines.written

    def written(df, name):
        if name == "line-alike":
            moved.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(lines, "written", written)
    rng = random.Random(3)
    base = [_line(rng, 12) for _ in range(150)]
    texts = base + [x + " ab" for x in base]
    rows = [(k, rng.getrandbits(62), 0, 0, 0, 7, x) for k, x in enumerate(texts)]
    members = lines.written(spark.createDataFrame(rows, "node long, sim0 long, sim1 long, sim2 long, sim3 long, root long, text string"), "members")
    found = lines.connected(lines._verified_links(members, lines.SIMILARITY, 256)).groupBy("root").agg(F.sort_array(F.collect_list("node")).alias("n")).collect()
    assert sorted(r["n"] for r in found) == [[k, k + 150] for k in range(150)]
    assert len(moved) == (5 if chars == 1 else 1)


def test_no_files_stay(spark: SparkSession):
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*line*"))
    rng = random.Random(5)
    base = [_line(rng, 10) for _ in range(20)]
    docs = spark.createDataFrame([*enumerate(base), *((100 + k, x + " ab") for k, x in enumerate(base))], "doc_id long, text string")
    assert lines.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 20
    assert [x for x in set(folder.glob("*line*")) - before if list(x.glob("*.parquet"))] == []


def test_lines_hold_no_sketches_while_texts_move(spark: SparkSession, monkeypatch):
    """The sketches of all lines were on disk beside the shuffle of the texts."""
    folder, found, members = Path(checkpoint_dir(spark).removeprefix("file:")), [], lines._members
    before = set(folder.glob("*line*"))

    def seen(rows, nodes, candidates):
        made = set(folder.glob("*line*")) - before
        found.extend(x.name.rsplit("-", 1)[0] for x in made if list(x.glob("*.parquet")) and "sim0" in spark.read.parquet(str(x)).columns)
        return members(rows, nodes, candidates)

    monkeypatch.setattr(lines, "_members", seen)
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five six"), (3, "one two three four five")], "doc_id long, text string")
    assert {r["did"] is not None for r in lines.repeated_lines(docs).collect()} == {True}
    assert found == ["line-nodes"]
