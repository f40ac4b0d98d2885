"""Print compact physical plans of the key operators (used for PLANS.md).

usage: python tools/plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "Window", "Aggregate", "Scan", "MapInArrow", "MapInPandas", "ArrowEvalPython",
        "Generate", "Sort ", "FlatMapGroupsInPandasWithState", "StateStore", "Union", "Expand")


def compact(plan: str) -> str:
    out = []
    for line in plan.splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            line = re.sub(r"Location: [^,]+, ", "", line)
            line = re.sub(r"(functions=\[).{60,}?(\], output)", r"\1...\2", line)
            out.append(line[:150].rstrip())
    return "\n".join(out)


def show(title, df):
    df.write.format("noop").mode("overwrite").save()
    print(f"### {title}\n```\n{compact(df._jdf.queryExecution().executedPlan().toString())}\n```\n")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import functions as F

    from rankwell.operators import metrics as M
    from rankwell.operators.contains import contains_pairs
    from rankwell.operators.score import search
    from rankwell.session import local_session
    from rankwell.sources.families import mem_family, vec_family

    spark = local_session(8, shuffle_partitions=16)
    fam = vec_family(spark, sf)
    show("search: query blocks broadcast (size check passed)", search(fam.queries, fam.corpus, 10))
    show("search: salted block join (size check failed)",
         search(fam.queries, fam.corpus, 10, broadcast_bytes=0, query_block_bytes=64 << 10))
    mem = mem_family(spark, sf)
    show("search restricted to groups (conversation)",
         search(mem.queries, mem.corpus, 5, group_cols=["conv_id"]))
    run = search(fam.queries, fam.corpus, 10)
    show("per-query metrics", M.per_query(run, fam.qrels, (1, 10)))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("did"), "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("pid"), "text")
    show("containment join (Aho-Corasick over passage blocks)", contains_pairs(docs, bench))


if __name__ == "__main__":
    main()
