"""Driver contract: entry smoke, registry and oracle names."""

import subprocess
import sys

import __spark_entry__ as E
from rankwell.plans.catalog import REGISTRY


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"metric", "k", "value"}


def test_every_query_has_an_oracle():
    q, o = E.queries(), E.oracle_sql()
    assert set(REGISTRY) <= set(q) and set(REGISTRY) <= set(o)
    assert all(callable(f) for f in q.values())


def test_entry_works_without_the_optional_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name == 'corpus_pipeline' or name.startswith('rankwell.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as E\n"
        "from rankwell.plans.catalog import REGISTRY\n"
        "assert set(E.queries()) == set(REGISTRY) and set(E.oracle_sql()) == set(REGISTRY)\n"
    )
    root = E.__file__.rpartition("/")[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
