"""What tests share."""

from ledgerstone.schemas import REGISTRY, REGISTRY_COLUMNS

DATA = "/root/testdata/sf0.001"


def same_rows(df, con, sql):
    """Both engines' rows, columns by name, floats to nine digits."""

    def cell(v):
        return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want
    return len(got)


def run(order, campaign, run_id, parent, role, scope, status, decision, value, guard="ok"):
    return (order, campaign, run_id, parent, role, "axis", "change", scope, status, decision, "f1", value, guard, "a.json;b.json", "report", "")


RUNS = (
    run("01", "c1", "b1", "root", "baseline", "v1", "completed", "keep", "0.50"),
    run("02", "c1", "r2", "b1", "candidate", "v1", "completed", "keep", "0.61"),
    run("03", "c1", "r3", "r2", "candidate", "v1", "completed", "keep", "0.40"),
    run("04", "c1", "r4", "zz", "candidate", "v1", "failed", "discard", None),
    run("05", "c1", "r2", "b1", "candidate", "v1", "completed", "discard", "0.20"),
    run("01", "c2", "x1", "root", "candidate", "v1", "completed", "maybe", "0.70"),
    run("02", "c2", "x2", "x1", "baseline", "v1", "completed", "keep", "n/a"),
    run("03", "c2", "x3", "x2", "candidate", "v2", "timed_out", "blocked", None),
)


def runs(spark):
    """A registry of a few runs, some of which break rules."""
    return spark.createDataFrame(list(RUNS), REGISTRY)
