"""Caller's functions: what is grounded counts, the rest is told."""

from thicket.operators import callbacks, lod

TEXTS = {
    ("g", 0): "Mean latency four boxes: the timing in milliseconds", ("g", 1): "Median latency six boxes: the time", ("g", 2): "Mean errors four boxes: the number of errors",
    ("g", 3): "Median errors six boxes: completed trials", ("g", 4): None, ("few", 0): "Mean latency", ("same", 0): "Mean a1", ("same", 1): "Mean b2", ("same", 2): "Mean c3", ("same", 3): "Mean d4",
}


def functions():
    """Made here, so that they travel to the workers by value."""

    def extract(concepts, fulls, samples):
        assert len(concepts) <= callbacks.BATCH and all(len(s) <= 3 for s in samples)
        out = []
        for c, full in zip(concepts, fulls):
            w = c.split()
            own = {"statistic": f'"{w[0]}"', "measure": w[1].upper() if len(w) > 2 else "", "other": w[0], "condition": None}
            if "four" in c:
                own["subtype"] = "timed" if "latency" in c else "boxing errors"  # stems stand in the text
            if "six" in c:
                own["subtype"] = "the number of boxes" if "latency" in c else "invented thing"
            out.append(own)
        return out

    def broken(concepts, fulls, samples):
        if any("six" in c for c in concepts):
            raise RuntimeError("no")
        return extract(concepts, fulls, samples)

    return extract, broken


def table(spark):
    return spark.createDataFrame([(g, r, t) for (g, r), t in TEXTS.items()], "grp string, row long, text string")


def test_roles_of_rows(spark):
    extract, _ = functions()
    found, audit = callbacks.row_roles(table(spark), extract, coverage=0.6)
    got = {(r.grp, r.row, r.role): r.value for r in found.collect()}
    assert {g for g, _, _ in got} == {"g"} and {role for _, _, role in got} == {"statistic", "measure", "subtype"}
    assert got[("g", 0, "statistic")] == "Mean" and got[("g", 1, "measure")] == "LATENCY" and got[("g", 0, "subtype")] == "timed" and got[("g", 2, "subtype")] == "boxing errors"
    told = {(r.grp, r.row, r.role): (r.accepted, r.reason) for r in audit.collect()}
    assert told[("g", 1, "subtype")] == (False, "boilerplate") and told[("g", 3, "subtype")][1] == "invent, thing" and told[("g", 0, "other")] == (False, "unknown role")
    assert ("few", 0, "statistic") not in told and not any(row == 4 for _, row, _ in told) and told[("same", 0, "statistic")] == (True, "accepted")
    assert callbacks.row_roles(table(spark), extract, coverage=0.9)[0].count() == 0
    assert callbacks.row_roles(table(spark).limit(0), extract)[1].count() == 0


def test_failures_are_in_the_audit(spark):
    _, broken = functions()
    _, audit = callbacks.row_roles(table(spark).where("grp = 'g'").coalesce(1), broken, batch=1)
    told = [(r.row, r.reason) for r in audit.where("role IS NULL").collect()]
    assert sorted(told) == [(1, "exception: RuntimeError"), (3, "exception: RuntimeError")]
    _, audit = callbacks.row_roles(table(spark).where("grp = 'g'").coalesce(1), lambda *a: [], batch=2)
    assert {r.reason for r in audit.collect()} == {"0 answers for 2 rows"}


def test_labels_are_grounded(spark):
    nodes = spark.createDataFrame([(1, "Group", ["latency", "error"], "DMS", ["mean time"]), (2, "Kept", ["a"], None, None), (3, "Empty", None, "x", []), (4, "Path", [], "Long Path", [])], "node long, candidate string, terms array<string>, path string, samples array<string>")
    say = {"Group": "Latency Errors of DMS", "Kept": "Invented", "Empty": "", "Path": "path"}
    found = {r.node: (r.label, r.accepted, r.reason) for r in callbacks.refined_labels(nodes, lambda c, t, p, s: [say[x] for x in c]).collect()}
    assert found == {1: ("Latency Errors of DMS", True, "accepted"), 2: ("Kept", False, "ungrounded: invent"), 3: ("Empty", False, "empty"), 4: ("path", True, "accepted")}


def test_the_builder_takes_roles_of_rows_first(spark):
    rows = [(i, f"v{i}", "DMS", f"{s} {m} u{i}: text") for i, (s, m) in enumerate((s, m) for s in ("Mean", "Median", "Total") for m in ("latency", "errors", "span") for _ in range(2))]
    named = lambda c, f, s: [{"statistic": x.split()[0], "measure": x.split()[1]} for x in c]
    built = lod.build(spark.createDataFrame(rows, "row long, label string, grp string, text string"), extract=named)
    own = {(r.name, r.route) for r in built.nodes.where("type = 'aggregation'").collect()}
    assert {("Latency", "per_row_extraction"), ("Errors", "per_row_extraction"), ("Span", "per_row_extraction"), ("DMS", "group_anchor")} <= own
    assert built.nodes.where("type = 'attribute'").count() == len(rows)
