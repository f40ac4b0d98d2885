"""What the lifecycle computes once, however many chunks an embedding has."""

import io
import json
import tarfile
import uuid

from pyspark.sql import functions as F

from rankwell.plans import store
from rankwell.plans.evaluate import RetrievalTask
from rankwell.sources.task_files import load_task


def test_rows_to_embed_are_computed_once_whatever_the_chunks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def costly(batches):
        for b in batches:
            (seen / f"{uuid.uuid4().hex}-{b.num_rows}").touch()
            yield b

    rows = spark.range(90).select(F.lit("").alias("subset"), F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("data"))
    rows = rows.mapInArrow(costly, rows.schema)
    calls = []

    def embed(part):
        calls.append(part.count())
        return part.select("subset", "source", "id", F.array(F.col("id").cast("double")).alias("vec"))

    got = store.embed_missing(rows, embed, str(tmp_path / "vecs"), "m", "T", "query", ["data"], chunk_rows=20)
    assert sorted((int(r.id), r.vec[0]) for r in got.collect()) == [(i, float(i)) for i in range(90)]
    assert len(calls) == 5 and sum(calls) == 90
    assert sum(int(f.name.split("-")[1]) for f in seen.iterdir()) == 90  # rows computed


def test_a_tar_is_walked_once_per_task(spark, tmp_path):
    with tarfile.open(tmp_path / "p.tar", "w") as tar:
        for i in range(3):
            info = tarfile.TarInfo(f"{i}.png")
            info.size = 2
            tar.addfile(info, io.BytesIO(b"%d!" % i))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": f"d{i}", "data": json.dumps({"path": f"{i}.png"})}) for i in range(3)))
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q", "data": "t"}))
    (tmp_path / "l.tsv").write_text("q\td1\t1")
    task = RetrievalTask.from_dict({"name": "T", "data": {
        "query": {"path": "json", "modal": "TEXT", "load_kwargs": {"data_files": str(tmp_path / "q.jsonl")}},
        "collection": {"path": "json", "modal": "IMAGE", "load_kwargs": {"data_files": str(tmp_path / "c.jsonl")}},
        "label": {"path": str(tmp_path / "l.tsv"), "modal": "LABEL", "xjx_style": True}, "packages": {"p": {"path": str(tmp_path / "p.tar")}}}})
    corpus = load_task(spark, task).corpus
    assert {r.id: bytes(r.image) for r in corpus.collect()} == {f"d{i}": b"%d!" % i for i in range(3)}
    plan = corpus._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1  # the byte ranges; the members are a table
