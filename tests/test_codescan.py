import pytest
from pyspark.sql import functions as F

from tablesmith.operators import codescan as K
from tablesmith.operators import rules
from tablesmith.session import deal

SCRIPTS = {
    "a.py": "p = '/mnt/d/a.csv'\ndf = pd.read_csv(p)\ndf.to_parquet('/mnt/out/a')\nm = df['t'].dt.to_period('M')\n",
    "b.py": "%pip install x\nx = pd.read_json('b.json', lines=True)\n",
    "c.py": "sc = SparkContext()\nsc.textFile('x').rdd\nSQLContext\n",
    "d.py": "def broken(:\n",
    "e.py": "q = '/dbfs/mnt/a'\npd.read_csv(q + '/f.csv')\npd.read_parquet(f'{q}/g')\npd.read_csv(unknown)\ndf.to_csv(path_or_buf=q)\ndf.to_json()\n",
}


@pytest.fixture(scope="module")
def scripts(spark):
    return spark.createDataFrame(list(SCRIPTS.items()), "path string, text string")


@pytest.fixture(scope="module")
def facts(scripts):
    return K.script_facts(scripts)


def test_access(facts):
    found = {
        (r["file_path"], r["line_number"], r["operation_type"], r["path_used"], r["variable_name"], r["is_mount_point"])
        for r in K.access_findings(facts).collect()
    }
    assert found == {
        ("a.py", 2, "pandas_read_csv", "/mnt/d/a.csv", "p", True),
        ("a.py", 3, "pandas_to_parquet", "/mnt/out/a", None, True),
        ("b.py", 2, "pandas_read_json", "b.json", None, False),
        ("e.py", 2, "pandas_read_csv", "/dbfs/mnt/a/f.csv", "expression", True),
        ("e.py", 3, "pandas_read_parquet", "/dbfs/mnt/a/g", "expression", True),
        ("e.py", 4, "pandas_read_csv", None, "unknown", False),
        ("e.py", 5, "pandas_to_csv", "/dbfs/mnt/a", "q", True),
    }


def test_mounts_errors_counts(facts):
    assert K.mount_references(facts).where("file_path = 'a.py'").count() == 2
    errors = K.scan_errors(facts).collect()
    assert [r["file_path"] for r in errors] == ["d.py"] and errors[0]["error"].startswith("SyntaxError")
    counts = {r["file_path"]: (r["reads"], r["writes"], r["mount_points"]) for r in K.access_counts(facts).collect()}
    assert counts == {"a.py": (1, 1, 2), "b.py": (1, 0, 0), "c.py": (0, 0, 0), "d.py": (0, 0, 0), "e.py": (3, 1, 3)}


def test_migration(scripts):
    flags = K.migration_flags(scripts, keep_unflagged=True)
    found = {(r["path"], r["severity"]) for r in flags.where("flag IS NOT NULL").collect()}
    assert found == {("c.py", "HIGH"), ("c.py", "MEDIUM")}
    levels = {r["path"]: r["risk_level"] for r in rules.risk_level(flags, ["path"]).collect()}
    assert levels["c.py"] == "HIGH" and levels["a.py"] == "LOW"
    assert [tuple(r) for r in K.old_interfaces(scripts).collect()] == [("c.py", "SQLContext", "Use SparkSession")]
    new = scripts.where("path = 'c.py'").select(K.modernised("text").alias("t")).first()["t"]
    assert "\nSparkSession\n" in new and "SparkContext" in new


def test_snippets(spark):
    expected = {
        "pd.read_csv('x')": "Safe",
        "pd.read_csv(open('x'))": "Dangerous function 'open' detected",
        "pd.read_csv(a.system('x'))": "Dangerous operation 'system' detected",
        "os.system('x')": "Module 'os' not allowed",
        "pd.to_csv('x')": "Operation 'to_csv' not allowed (only read operations)",
        "f(1)": "Not a valid pandas/spark read operation",
        "1 + 1": "Code must be a single function call",
        "import os": "Invalid Python syntax",
    }
    df = K.snippet_safety(spark.createDataFrame([(s,) for s in expected], "text string"))
    assert {r["text"]: r["reason"] for r in df.collect()} == expected
    assert df.where("is_safe").count() == 1


def test_line_changes(spark):
    df = spark.createDataFrame([("a\nb\n\nd", "a\nB\nx\nD")], "a string, b string")
    changes = K.line_changes(F.col("a"), F.col("b"))
    row = df.select(F.size(changes).alias("n"), changes.alias("c"), K.confidence(F.size(changes)).alias("s")).first()
    assert row["n"] == 2 and row["s"] == pytest.approx(0.9)
    assert [(c["line_number"], c["original"], c["converted"]) for c in row["c"]] == [(2, "b", "B"), (4, "d", "D")]


def paths(spark, text):
    facts = K.script_facts(spark.createDataFrame([("x.py", text)], "path string, text string"))
    return {r.line_number: r.path_used for r in K.access_findings(facts).collect()}


def test_names_hold_what_was_bound_last(spark):
    text = """p = 'a'
pd.read_csv(p)
p = 'b'
pd.read_csv(p)
p = p + '/c'
pd.read_csv(p)
p = other()
pd.read_csv(p)
x = y = 'd'
pd.read_csv(x + y)
if t:
    x = 'e'
    pd.read_csv(x)
else:
    x = 'f'
pd.read_csv(x)
while t:
    pd.read_csv(y)
    y = 'g'
    pd.read_csv(y)
pd.read_csv(y)
try:
    z = 'h'
except E as y:
    z = 'h'
pd.read_csv(z)
with open('k') as z:
    pd.read_csv(z)
once, w = 'n', 'w'
single = 's'
def f(a, z='u'):
    pd.read_csv(a)
    q = 'own'
    pd.read_csv(q)
    pd.read_csv(single)
    pd.read_csv(p)
pd.read_csv([pd.read_csv(v) for v in vs][0])
match t:
    case 1:
        m = 'x'
    case v:
        m = 'x'
pd.read_csv(later)
later = 'l'
"""
    lines = text.split("\n")
    got = paths(spark, text)
    at = {line.strip(): i + 1 for i, line in enumerate(lines)}
    assert [got[i] for i in (2, 4, 6, 8, 10, 13, 16, 18, 20, 21)] == ["a", "b", "b/c", None, "dd", "e", None, None, "g", None]
    assert got[26] == "h" and got[28] is None
    assert got[at["pd.read_csv(a)"]] is None and got[at["pd.read_csv(q)"]] == "own" and got[at["pd.read_csv(single)"]] == "s"
    assert got[at["pd.read_csv(later)"]] is None


def test_rows_of_one_row_group_are_dealt_evenly(spark, tmp_path):
    """A file of one row group and many splits has one task with all rows unless they are dealt."""
    spark.range(20000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    sizes = sorted(r["count"] for r in deal(rows, 2000).groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) >= 10 and sizes[-1] <= 2500


def test_counts_belong_to_their_own_row(spark):
    """Counts need no join: a script without a path keeps its own."""
    rows = [(None, "a = pd.read_csv('/mnt/a')"), ("x.py", "a.to_csv('b')"), ("x.py", "def (")]
    counts = K.access_counts(K.script_facts(spark.createDataFrame(rows, "path string, text string"), code=False)).collect()
    assert sorted(map(str, (tuple(r) for r in counts))) == sorted(map(str, [(None, True, 1, 0, 1), ("x.py", True, 0, 1, 0), ("x.py", False, 0, 0, 0)]))
