"""Small scenarios: a branched history, scopes, lookups, ingest, retention, the stream, trees and documents."""

import time

import pytest
from pyspark.sql import functions as F

from heddle.model import TABLES, Archive, Config, columns, ingest, ingest_schemas, schema
from heddle.operators import dag, lookup, manifest, namespaces, nodes, portable, purge, readiness, records, rules
from heddle.sources import files
from heddle.streaming import events as stream


def rows(spark, table, *given):
    out = []
    for i, g in enumerate(given):
        row = {c: None for c in columns(table)} | {"ordinal": i, "pos": i} | g
        out.append(tuple(row[c] for c in columns(table)))
    return spark.createDataFrame(out, schema(table))


def obj(o, r, content=None, ns="demo", kind="demo/thing"):
    return dict(object_id=o, revision_id=r, content_id=content, ns_id=ns, ns_uuid="", ns_display="", kind=kind, schema_ns=ns, schema_id="thing", schema_version="1")


@pytest.fixture(scope="module")
def history(spark):
    """r0; r1 and r2 on it; r3 merges them. state@r1 refers to geom, pinned to r0; mesh@r2 refers to late, which only r3 has."""
    objects = rows(spark, "objects", obj("geom", "r0", "g"), obj("state", "r0", "x"), obj("state", "r1", "x"), obj("state", "r3", "x"), obj("mesh", "r2", "y"), obj("late", "r3"))
    refs = rows(
        spark, "refs",
        dict(owner=2, object_id="state", revision_id="r1", name="geometry", target_object="geom", target_revision="r0"),
        dict(owner=4, object_id="mesh", revision_id="r2", name="late", target_object="late"),
        dict(owner=4, object_id="mesh", revision_id="r2", name="geometry", target_object="geom"),
    )
    frames = dict(
        objects=objects,
        refs=refs,
        revisions=rows(spark, "revisions", dict(revision_id="r0"), dict(revision_id="r1", run_id="run-1"), dict(revision_id="r2"), dict(revision_id="r3", run_id="run-merge")),
        edges=spark.createDataFrame([("r1", "r0", 0), ("r2", "r0", 0), ("r3", "r1", 0), ("r3", "r2", 1)], "child string, parent string, pos bigint"),
        heads=rows(spark, "heads", dict(head_id="h1", name="main", revision_id="r1"), dict(head_id="h2", name="topic", revision_id="r2")),
        runs=rows(
            spark, "runs",
            dict(run_id="run-1", revision_id="r1", status="completed", software_environment="env", restart_declared=True),
            dict(run_id="run-merge", revision_id="r3", status="completed", restart_declared=False),
            dict(run_id="run-failed", status="failed", restart_declared=False),
        ),
        activities=rows(spark, "activities", dict(run_id="run-1", activity_id="a1", declared_run_id="run-1", operation="solve", reuse="computed")),
        checkpoints=rows(spark, "checkpoints", dict(run_id="run-1", object_id="geom", content_id="g")),
        log_streams=rows(spark, "log_streams", dict(run_id="run-failed", kind="stderr", retention="debug"), dict(run_id="run-1", kind="stdout", retention="pinned")),
    )
    return Archive.of(frames)


def entries(m):
    return {(r["root"], r["object_id"], r["revision_id"], r["availability"]) for r in m.entries.collect()}


def test_manifest_resolves_in_scope(spark, history):
    m = manifest.manifests(history, history.heads)
    assert entries(m) == {
        ("r1", "state", "r1", "envelope_only"), ("r1", "geom", "r0", "envelope_only"),
        ("r2", "mesh", "r2", "envelope_only"), ("r2", "geom", "r0", "envelope_only"), ("r2", "late", None, "missing"),
    }
    assert rules.dangling_references(history).count() == 0  # it exists, but r2 doesn't see it
    externals = rows(spark, "externals", dict(object_id="late", content_id="z", artifact_kind="file"))
    outside = manifest.inspect(history, externals, name="topic")
    assert ("r2", "late", None, "external_required") in entries(outside)
    assert manifest.readiness(history, outside, "inspect").count() == 0
    assert {r["code"] for r in manifest.readiness(history, outside, "replay").collect()} == {"external_content_required", "replay_run_missing"}


def test_manifest_readiness_and_select(history):
    m = manifest.checkout(history, revision_id="r1")
    for target in ("inspect", "replay", "restart", "rerun"):
        assert manifest.readiness(history, m, target).count() == 0, target
    assert [r["code"] for r in manifest.readiness(history, m, "fly").collect()] == ["unsupported_target"]
    assert manifest.select(m, "geom").count() == 1
    head = manifest.header(history, m).collect()[0]
    assert (head["run_id"], head["objects"], head["missing"], head["heads"]) == ("run-1", 2, 0, 1)
    with pytest.raises(LookupError):
        manifest.inspect(history, revision_id="r9")


def test_purge_keeps_what_a_head_reaches(spark, history):
    sizes = spark.createDataFrame([("x", 10), ("g", 5), ("y", 7)], "content_id string, bytes long")
    p = purge.plan(history, [purge.Root("head", name="main")], sizes=sizes)
    n = {r["what"]: r["n"] for r in p.summary.collect()}
    assert (n["retained_revisions"], n["omitted_revisions"], n["retained_bytes"], n["omitted_bytes"], n["retained_content"]) == (2, 2, 15, 7, 2)
    got = {(r["object_id"], r["revision_id"]) for r in p.reach.objects.collect()}
    assert got == {("state", "r1"), ("geom", "r0")}
    small = purge.compact(history, p.reach, p.policy)
    assert {r["run_id"] for r in small.runs.collect()} == {"run-1"}
    assert [r["kind"] for r in small.log_streams.collect()] == ["stdout"]
    assert rules.is_valid(purge.verify(small, p.reach))
    with pytest.raises(LookupError):
        purge.reachable(history, [purge.Root("run", id="nobody")])


def test_publish_marks_only_sound_archives(spark, history, tmp_path):
    _, _, good = purge.publish(history, [purge.Root("revision", revision_id="r1")], f"file://{tmp_path}/good")
    assert good and (tmp_path / "good" / "_VERIFIED").exists()
    _, wrong, bad = purge.publish(history, [purge.Root("object", id="mesh", revision_id="r2")], f"file://{tmp_path}/bad")
    assert not bad and not (tmp_path / "bad" / "_VERIFIED").exists()
    assert "missing_manifest_object" in {r["code"] for r in wrong.collect()}
    again = files.load(spark, f"file://{tmp_path}/good")
    assert again.objects.count() == 2


def test_lookups(spark, history):
    assert [r["object_id"] for r in lookup.find_objects(history, "r0").collect()] == ["geom", "state"]
    assert lookup.find_revisions(history, "state").count() == 3
    b = lookup.branch_from(history, "r0", "h3", "main")
    assert b.heads.count() == 3 and history.heads.count() == 2
    with pytest.raises(lookup.Ambiguous):
        lookup.find_head(b, name="main")


def test_timeline_ignores_the_clock(spark):
    events = rows(
        spark, "events",
        dict(kind="b", run_id="r", sequence=1, source="rank-0", severity="info", message="", retention="debug", timestamp="2020-01-01T12:00:02Z"),
        dict(kind="a", run_id="r", sequence=0, source="rank-0", severity="info", message="", retention="debug", timestamp="2020-01-01T12:00:09Z"),
        dict(kind="z", run_id="r", source="rank-0", severity="info", message="", retention="debug"),
        dict(kind="y", run_id="r", source="rank-0", severity="info", message="", retention="debug"),
    )
    a = Archive.of({"events": events})
    assert [r["kind"] for r in lookup.timeline(a, "r").collect()] == ["a", "b", "z", "y"]


def test_gates(history):
    got = {(r["subject"], r["code"]) for r in readiness.archive_commit(history).collect()}
    assert ("run-failed", "run_not_completed") in got and ("run-1", "run_already_committed") in got
    assert {r["code"] for r in readiness.gate(history, "commit", history.runs.select(F.lit("nobody").alias("run_id")).limit(1)).collect()} == {"missing_commit_run"}
    assert [r["code"] for r in readiness.gate(history, "fly").collect()] == ["unsupported_target"]
    ready = {r["run_id"]: r["ready"] for r in readiness.ready(history, readiness.run_restart(history)).collect()}
    assert ready == {"run-1": False, "run-merge": False, "run-failed": False}


def test_event_batch(spark):
    events = rows(
        spark, "events",
        dict(kind="a", run_id="r", sequence=0, severity="info", message="ok", retention="debug"),
        dict(kind="b", run_id="q", sequence=0, severity="info", message="bearer abcdefghijklmnopqrstuvwxyz", retention="debug"),
        dict(kind="c", run_id="r", sequence=0, severity="info", message="ok", retention="debug"),
    )
    got = sorted(r["code"] for r in rules.event_batch(events, write={"scope": "archive", "phase": "begin"}).collect())
    assert got == ["credential_like_content", "duplicate_event_sequence", "event_batch_run_mismatch", "event_batch_write_scope", "missing_writer_token"]
    assert [r["code"] for r in rules.event_batch(events.where("run_id = 'q' AND sequence = 9"), write={"scope": "run", "run_id": "z", "phase": "committed"}).collect()] == []


def test_stream(spark, tmp_path):
    def put(name, *given):
        rows(spark, "events", *given).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")

    base = dict(severity="info", message="", retention="debug", source="s")
    put("", dict(base, kind="a", run_id="r", sequence=0), dict(base, kind="b", run_id="q", sequence=0, message="key sk-abcdefghij0123456789"))
    put("", dict(base, kind="c", run_id="r", sequence=0), dict(base, kind="d", run_id="r", sequence=1))
    source = files.event_stream(spark, f"{tmp_path}/in")
    stream.append(source, f"{tmp_path}/table", f"{tmp_path}/aside", f"{tmp_path}/c1").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/table").collect()
    aside = {(r["run_id"], r["codes"]) for r in spark.read.parquet(f"{tmp_path}/aside").collect()}
    assert ("q", "credential_like_content") in aside and "q" not in {r["run_id"] for r in stored}
    with stream.state_store(spark):
        q = stream.repeats(source).writeStream.format("memory").queryName("repeats").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["run_id"], r["source"], r["sequence"]) for r in spark.sql("SELECT * FROM repeats").collect()] == [("r", "s", 0)]


def test_ingest_trims_and_refuses(spark):
    raw = spark.createDataFrame([(" r ", "", "completed")], "run_id string, plan_id string, status string")
    full = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in columns("runs") if c not in raw.columns and c not in ("ordinal", "restart_declared")]).withColumn("ordinal", F.lit(1)).withColumn("restart_declared", F.lit(False))
    row = ingest("runs", full).collect()[0]
    assert (row["run_id"], row["plan_id"]) == ("r", None)
    with pytest.raises(Exception, match="bad value"):
        ingest("runs", full.withColumn("status", F.lit("asleep"))).collect()
    with pytest.raises(Exception, match="bad value"):
        ingest("runs", full.withColumn("run_id", F.lit("  "))).collect()
    with pytest.raises(ValueError):
        Archive.of({"runs": raw})
    with pytest.raises(Exception, match="reused needs"):
        given = rows(spark, "staged", dict(run_id="r", object_id="o", ns_id="n", ns_uuid="", ns_display="", kind="n/k", schema_ns="n", schema_id="k", schema_version="1", origin="reused"))
        ingest("staged", given).collect()


def test_empty_archive_is_valid(spark):
    a = Archive.of({"objects": spark.createDataFrame([], schema("objects"))}, Config())
    assert rules.validate(a, namespaces=True, catalog=True).count() == 0
    assert set(TABLES) == set(a.frames)


def test_listing_folds_identity_in_insertion_order(spark):
    def o(n, uuid, display, kind="demo/a"):
        return obj(f"o{n}", "r", kind=kind) | dict(ns_uuid=uuid, ns_display=display)

    a = Archive.of({"objects": rows(spark, "objects", o(1, "", "Zeta"), o(2, "u1", "Alpha"), o(3, "u1", "Beta", "demo/b"))})
    r = namespaces.listing(a, with_claims=False).collect()[0]
    assert (r["ns_uuid"], r["display"], r["kinds"]) == ("u1", "Beta", "demo/a,demo/b")  # the first UUID replaced the greater name
    claims = rows(spark, "claims", dict(ns_id="demo", ns_uuid="u1", ns_display="", role="domain", status="active", canonical_id="demo"), dict(ns_id="old", ns_uuid="", ns_display="", role="domain", status="alias", canonical_id="demo"))
    aliases = rows(spark, "claim_aliases", dict(ns_id="demo", claim=0, alias="dm"))
    b = a.replaced(claims=claims, claim_aliases=aliases)
    got = {r["ns_id"]: (r["status"], r["canonical_id"], r["aliases"]) for r in namespaces.listing(b).collect()}
    assert got["demo"] == ("active", "demo", "dm") and got["old"][:2] == ("alias", "demo")


def tree():
    plate = portable.Node("shape/rectangle", "plate", {"width": 2.0, "tags": (portable.Symbol("a"), "b")})
    block = portable.Node("shape/extrude", "block", {"profile": portable.Ref("plate"), "origin": (0.0, 1.0), "extra": None, "n": 3, "m": portable.Array((2, 1), (1.0, 2.0)), "d": {"k": True, portable.Symbol("s"): 1 + 2j}})
    return portable.Node("shape/geometry", "demo", {}, [plate, block])


def test_portable_round_trip(spark):
    doc = portable.capture("d", [tree()])
    assert portable.restore(portable.from_json(portable.to_json(doc))) == [tree()]
    text = portable.s_expression(doc)
    assert text == portable.s_expression(portable.capture("d", [tree()])) and "(profile (ref plate))" in text
    n, a = portable.tables(spark, doc)
    assert nodes.walk(n).count() == 3
    assert nodes.equal(n, a, n, a).collect()[0]["equal"]
    changed = nodes.set_attribute(a, a.where("key = 'width'").withColumn("value", F.lit("3.0")))
    assert not nodes.equal(n, a, n, changed).collect()[0]["equal"]


def test_portable_refuses_everything_without_a_form():
    bad = portable.Node("x", "x", {"a": object(), "b": [1 << 70], "c": portable.Array((), ()), "d": {1: 2}})
    assert [p for _, p, _ in portable.check([bad, bad])] == ["x/a", "x/b/#1", "x/c", "x/d"] * 2 + ["x"]
    with pytest.raises(portable.Unportable):
        portable.capture("d", [bad])
    portable.register_codec("set", frozenset, lambda s: sorted(s), frozenset)
    assert portable.restore(portable.capture("d", [portable.Node("k", None, {"s": frozenset({1, 2})})]))[0].attributes["s"] == frozenset({1, 2})


def test_registered_rules(spark):
    from heddle.functions import values

    values.register("even", lambda tag, v, p, ps: (tag == "integer") & (values.number(v) % 2 == 0))
    values.register_node("different", lambda attrs, fields: F.try_element_at(attrs, F.get(fields, 0)) != F.try_element_at(attrs, F.get(fields, 1)))
    tree = spark.createDataFrame([("n1", "k/a", "k/a"), ("n2", "k/a", "k/a")], "node_id string, kind string, expected string")
    attrs = spark.createDataFrame([("n1", "x", "integer", "3"), ("n1", "y", "integer", "3"), ("n2", "x", "integer", "4"), ("n2", "y", "integer", "5")], "node_id string, key string, tag string, value string")
    kinds = spark.createDataFrame([("k/a", True)], "kind string, allow_extra boolean")
    fields = spark.createDataFrame([("k/a", "x", "integer", True, False, [("even", None, None, "odd")])], f"kind string, name string, value_kind string, required boolean, allow_ref boolean, rules {nodes.RULES}")
    over = spark.createDataFrame([("k/a", "different", ["x", "y"], "")], "kind string, rule string, fields array<string>, message string")
    got = {(r.subject, r.code, r.related) for r in nodes.validate(tree, attrs, kinds, fields, over).collect()}
    assert got == {("n1", "validation_rule_failed", "x:even"), ("n1", "node_validation_rule_failed", "different")}


def test_sound_registries_and_purges(history):
    none = rules.validate(history).where("false")
    assert readiness.sound(none).count() == 0 and [r.code for r in readiness.sound(none, "fly").collect()] == ["unsupported_target"]
    assert [r.code for r in readiness.purge_result(none, False).collect()] == ["purge_unverified"]
    assert readiness.purge_result(none, True).count() == 0


def test_append_sets_aside_by_payload_and_write(spark, tmp_path):
    """Batches by a column of their own: a secret in a payload, a foreign event, a write of another run, and a sound one."""
    given = [("b1", "r1"), ("b2", "r1"), ("b2", "r2"), ("b3", "r3"), ("b4", "r4")]
    events = rows(spark, "events", *(dict(kind="k", run_id=r, severity="info", message="m", retention="debug") for _, r in given))
    units = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(given)], "ordinal long, unit string")
    events.join(units, "ordinal").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    payload = spark.createDataFrame([(0, "api_key", "x", True), (4, "size", "1", False)], "event long, key string, value string, is_text boolean")
    writes = spark.createDataFrame([("b3", "run", "begin", 1, "r9", None), ("b4", "run", "begin", 1, "r4", "t")], "batch string, scope string, phase string, sequence long, run_id string, writer_token string")
    stream.append(source, f"{tmp_path}/table", f"{tmp_path}/aside", f"{tmp_path}/c", unit="unit", payload=payload, writes=writes).awaitTermination()
    assert [r["run_id"] for r in spark.read.parquet(f"{tmp_path}/table").collect()] == ["r4"]
    aside = {r["ordinal"]: r["codes"] for r in spark.read.parquet(f"{tmp_path}/aside").collect()}
    assert aside == {0: "credential_like_content", 1: "event_batch_run_mismatch", 2: "event_batch_run_mismatch", 3: "event_batch_write_run_mismatch,missing_writer_token"}
    assert [r["ordinal"] for r in stream.screened(events, payload).where("suspect").collect()] == [0]


def test_single_records(spark, history):
    a = history.replaced(
        events=rows(spark, "events", dict(kind="k", run_id="run-1", severity="info", message="Bearer abcdefghij0123456789", retention="debug"), dict(kind="k", run_id="run-2", severity="info", message="m", retention="debug")),
        objects=rows(spark, "objects", obj("good", "r0"), obj("bad", "r0", kind="other/thing")),
    )
    assert records.validate(a, "object", object_id="good", revision_id="r0").count() == 0
    assert {r["code"] for r in records.validate(a, "object", object_id="bad").collect()} == {"kind_namespace_mismatch", "schema_kind_mismatch"}
    assert "missing_schema" in {r["code"] for r in records.validate(a, "object", True, object_id="good").collect()}
    assert records.validate(a, "event", ordinal=0).count() == 1 and records.validate(a, "event", ordinal=1).count() == 0
    assert records.report(a, "run", run_id="run-1").collect()[0].asDict() == dict(run_id="run-1", status="completed", revision_id="r1", activities=1, staged=0, checkpoints=1, committed=True)
    for kind in records.KINDS:
        records.validate(a, kind).collect(), records.report(a, kind).collect()
    with pytest.raises(LookupError):
        records.validate(a, "run", run_id="nobody")
    with pytest.raises(ValueError):
        records.validate(a, "run", name="x")
    line = records.render(records.validate(a, "event", ordinal=0)).collect()[0]["line"]
    assert line == "error credential_like_content [run-1, message]"
    registered = records.Kind("heads", ("head_id",), rules.heads, lambda x: x.heads)
    records.register("head", registered)
    try:
        assert records.validate(a, "head").count() == 0
    finally:
        del records.KINDS["head"]


def test_trees_are_equal_by_tagged_values(spark):
    def tree(*attrs, kind="a/b", extra=()):
        n = spark.createDataFrame([("t", None, 0, kind, None), *extra], "node_id string, parent_id string, child_pos long, kind string, name string")
        a = spark.createDataFrame([("t", *x, None, None) for x in attrs], "node_id string, key string, tag string, value string, items array<struct<tag:string,value:string>>, dims array<int>")
        return n, a

    def equal(x, y):
        return nodes.equal(*x, *y).collect()[0]["equal"]

    one = tree(("x", "string", "v"), ("y", "integer", "1"))
    assert equal(one, tree(("y", "integer", "1"), ("x", "string", "v")))
    assert not equal(one, tree(("x", "symbol", "v"), ("y", "integer", "1")))
    assert not equal(one, tree(("x", "string", "v"), ("y", "integer", "1"), ("z", "nothing", None)))
    assert not equal(one, tree(("x", "string", "v"), ("y", "integer", "1"), kind="a/c"))
    child = ("c", "t", 0, "a/d", "n")
    assert not equal(tree(("x", "string", "v")), tree(("x", "string", "v"), extra=[child]))
    wide = [(f"c{i}", "t", i, "a/d", None) for i in (200_000, 1_000_000, 3)]
    walked = nodes.walk(tree(extra=wide)[0]).orderBy("path").select("node_id").collect()
    assert [r["node_id"] for r in walked] == ["t", "c3", "c200000", "c1000000"]


def test_scripts_and_validated_nodes(spark):
    n, attrs = nodes.script(spark, "s", "solve", source="x = 1", language="any", inputs=["mesh"], outputs=["field"])
    assert n.collect()[0]["kind"] == nodes.SCRIPT
    assert {r["key"]: r["tag"] for r in attrs.collect()} == {"effects": "list", "inputs": "list", "outputs": "list", "language": "symbol", "source": "string"}
    for wrong in (dict(source=" "), dict(source="x", outputs=[1]), dict(source="x", inputs=[""])):
        with pytest.raises(ValueError):
            nodes.script(spark, "s", "solve", language="any", **wrong)
    schemas = (
        spark.createDataFrame([(nodes.SCRIPT, True)], "kind string, allow_extra boolean"),
        spark.createDataFrame([(nodes.SCRIPT, "source", "string", True, False, [])], f"kind string, name string, value_kind string, required boolean, allow_ref boolean, rules {nodes.RULES}"),
        spark.createDataFrame([], "kind string, rule string, fields array<string>, message string"),
    )
    expected = n.withColumn("expected", F.lit(nodes.SCRIPT))
    assert nodes.validated(expected, attrs, *schemas)[1] is attrs
    with pytest.raises(ValueError, match="source"):
        nodes.validated(expected, attrs.where("key <> 'source'"), *schemas)


def test_tables_and_schemas_are_checked(spark, history):
    with pytest.raises(TypeError, match="heads"):
        Archive.of({"heads": history.heads.withColumn("ordinal", F.lit("1"))})
    d = spark.createDataFrame([("n", "s", "1", "n", "exact_read", None, None)], "schema_ns string, schema_id string, schema_version string, ns_id string, compatibility string, migration_source string, migration_target string")
    f = spark.createDataFrame([("n", "s", "1", " f ", 2, [1, None])], "schema_ns string, schema_id string, schema_version string, name string, rank int, shape array<int>")
    good = ingest_schemas(d, f)
    assert good[0].count() == 1 and good[1].collect()[0]["name"] == "f"
    for wrong in (d.withColumn("compatibility", F.lit("x")), d.withColumn("migration_source", F.lit("a")), d.withColumns({"migration_source": F.lit("a"), "migration_target": F.lit("a")}), d.withColumn("schema_id", F.lit(" "))):
        with pytest.raises(Exception):
            ingest_schemas(wrong, f)[0].collect()
    for wrong in (f.withColumn("rank", F.lit(1)), f.withColumn("name", F.lit(" ")), f.withColumn("shape", F.array(F.lit(-1), F.lit(2)))):
        with pytest.raises(Exception):
            ingest_schemas(d, wrong)[1].collect()
    with pytest.raises(ValueError):
        from heddle.functions.columns import diagnostic

        diagnostic(d, "c", "schema_id", severity="dire")


def test_records_round_trip_and_verified_folders(spark, history, tmp_path):
    for table in ("objects", "runs", "log_streams", "revisions"):
        frame = getattr(history, table)
        assert sorted(map(str, files.from_records(files.to_records(history, table), table).collect())) == sorted(map(str, frame.collect()))
    files.save(history, f"file://{tmp_path}/a")
    assert files.load(spark, f"file://{tmp_path}/a").objects.count() == history.objects.count()
    with pytest.raises(ValueError):
        files.load(spark, f"file://{tmp_path}/a", verified=True)


def test_strides_from_few_roots(spark, monkeypatch):
    """A long chain with merges: the roots' frontier takes over after two doublings, and agrees with a queue."""
    import collections
    import random

    rnd = random.Random(3)
    parents = {f"n{i}": [f"n{j}" for j in dict.fromkeys([i - 1] + [rnd.randrange(i) for _ in range(rnd.randrange(3))])] if i else [] for i in range(60)}
    a = Archive.of(dict(
        revisions=rows(spark, "revisions", *(dict(revision_id=n) for n in parents)),
        edges=spark.createDataFrame([(c, p, k) for c, ps in parents.items() for k, p in enumerate(ps)], "child string, parent string, pos long"),
    ))
    monkeypatch.setattr(dag, "DENSE", 1)
    roots = a.revisions.where("revision_id IN ('n59', 'n30')")
    got = {(r["root"], r["rank"]): r["revision_id"] for r in dag.visible(a, roots).collect()}
    for root in ("n59", "n30"):
        queue, seen = collections.deque([root]), [root]
        while queue:
            for p in parents[queue.popleft()]:
                if p not in seen:
                    seen.append(p)
                    queue.append(p)
        assert [got[root, k] for k in range(len(seen))] == seen
    assert len(got) == 60 + 31


def test_tree_edits(spark):
    """Attributes are replaced or added; new children stand behind the old ones, in order of their ids."""
    tree = spark.createDataFrame([("t", None, 0, "a/b", None), ("x", "t", 4, "a/c", None)], "node_id string, parent_id string, child_pos long, kind string, name string")
    new = spark.createDataFrame([("z", "t", "a/c", None), ("y", "t", "a/c", "n"), ("v", "x", "a/c", None)], "node_id string, parent_id string, kind string, name string")
    grown = {r["node_id"]: (r["parent_id"], r["child_pos"], r["name"]) for r in nodes.add_children(tree, new).collect()}
    assert grown == {"t": (None, 0, None), "x": ("t", 4, None), "y": ("t", 5, "n"), "z": ("t", 6, None), "v": ("x", 0, None)}
    attrs = spark.createDataFrame([("t", "a", "string", "1"), ("t", "b", "string", "2")], "node_id string, key string, tag string, value string")
    changes = spark.createDataFrame([("t", "b", "integer", "3"), ("x", "a", "string", "4")], attrs.schema)
    got = {(r["node_id"], r["key"]): (r["tag"], r["value"]) for r in nodes.set_attribute(attrs, changes).collect()}
    assert got == {("t", "a"): ("string", "1"), ("t", "b"): ("integer", "3"), ("x", "a"): ("string", "4")}


def test_restart_checkpoints_of_an_object_with_many_versions(spark):
    """20,000 checkpoints of one object with 20,000 versions: they must not meet in pairs."""
    n = 20_000

    def many(table, **given):
        return spark.range(n).select(*[F.expr(given.get(f.name, {"ordinal": "id", "pos": "id"}.get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema(table)).schema])

    a = Archive.of({
        "objects": many("objects", object_id="'o'", revision_id="'v' || id", content_id="'c' || id"),
        "checkpoints": many("checkpoints", run_id="'r'", object_id="CASE id WHEN 1 THEN 'other' WHEN 2 THEN 'up' WHEN 3 THEN 'mine' ELSE 'o' END", content_id="CASE WHEN id = 0 THEN 'none' WHEN id < 4 THEN 'c' ELSE 'c' || id END", revision_id="CASE id WHEN 5 THEN 'v5' WHEN 6 THEN 'v7' END"),
        "runs": rows(spark, "runs", dict(run_id="r", parent_run_id="p", status="failed", restart_declared=True), dict(run_id="p", status="failed", restart_declared=False)),
        "staged": rows(spark, "staged", dict(run_id="p", object_id="up", content_id="c"), dict(run_id="r", object_id="mine")),
    })
    began = time.monotonic()
    got = sorted((r["code"], r["related"]) for r in readiness.checkpoints(a).collect())
    assert got == [("incompatible_restart_content", "o"), ("incompatible_restart_content", "o"), ("missing_restart_checkpoint", "other"), ("unverified_restart_content", "mine")]
    assert time.monotonic() - began < 60


def test_a_run_that_is_its_own_parent_keeps_no_revision_by_that(spark, history):
    """Its revision stays only where something else keeps it."""
    a = history.replaced(
        runs=rows(spark, "runs", dict(run_id="self", parent_run_id="self", revision_id="r3", status="completed", restart_declared=False)),
        revisions=rows(spark, "revisions", dict(revision_id="r0", run_id="self"), dict(revision_id="r1"), dict(revision_id="r2"), dict(revision_id="r3")),
        log_streams=history.log_streams.where("false"),
    )
    kept = purge.reachable(a, [purge.Root("revision", revision_id="r0")], purge.Policy())
    assert {r["run_id"] for r in kept.runs.collect()} == {"self"}
    assert {r["revision_id"] for r in kept.revisions.collect()} == {"r0"}


def test_long_chains_of_runs_and_revisions_take_few_steps(spark, history, monkeypatch):
    """A run leads to its parent's revision, that to the revision above it, and that to its maker, a run with a parent again; closures
    of objects are taken once, not with each such round."""
    from heddle import staging

    n, steps = 12, []
    for module in (dag, manifest, purge):
        monkeypatch.setattr(module, "stage", lambda df, name, **options: steps.append(name) or staging.stage(df, name, **options))
    a = history.replaced(
        runs=rows(spark, "runs", *[dict(run_id=f"m{i}", parent_run_id=f"p{i}" if i < n else None, status="completed", restart_declared=False) for i in range(n + 1)], *[dict(run_id=f"p{i}", revision_id=f"a{i}", status="completed", restart_declared=False) for i in range(n)]),
        revisions=rows(spark, "revisions", *[dict(revision_id=f"a{i}") for i in range(n)], *[dict(revision_id=f"b{i}", run_id=f"m{i + 1}") for i in range(n)], dict(revision_id="off")),
        edges=rows(spark, "edges", *[dict(child=f"a{i}", parent=f"b{i}", pos=0) for i in range(n)]),
        objects=rows(spark, "objects", *[dict(object_id=f"o{i}", revision_id=f"b{i}", ns_id="n", kind="n/k", schema_ns="n", schema_id="k", schema_version="1") for i in range(n)]),
        activity_refs=rows(spark, "activity_refs", *[dict(run_id=f"m{i + 1}", activity_id=f"t{i}", direction="used", name="x", object_id=f"o{i}") for i in range(n)], dict(run_id="m1", activity_id="t", direction="used", name="x", object_id="gone")),
        log_streams=history.log_streams.where("false"), events=history.events.where("false"), heads=history.heads.where("false"), refs=history.refs.where("false"),
    )
    kept = purge.reachable(a, [purge.Root("run", id="m0")], purge.Policy())
    assert {r["run_id"] for r in kept.runs.collect()} == {f"m{i}" for i in range(n + 1)} | {f"p{i}" for i in range(n)}
    assert {r["revision_id"] for r in kept.revisions.collect()} == {f"{k}{i}" for k in "ab" for i in range(n)}
    assert {r["object_id"] for r in kept.objects.collect()} == {f"o{i}" for i in range(n)}
    assert {(r["code"], r["related"]) for r in kept.diagnostics.collect()} == {("missing_activity_object", "gone")}
    assert steps.count("manifest-sights") == 1 and len(steps) < 6 * n
