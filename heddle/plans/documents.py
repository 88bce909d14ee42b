"""Queries of trees, payloads and embedded schemas. Conversations are trees of turns, documents and embeddings are records."""

from pyspark.sql import functions as F

from ..model import Archive
from ..operators import catalog, nodes, records
from ..sources.projection import CONFIG, archive, duckdb_sql
from .base import QUERIES, SQL, found

C, L = F.col, F.lit


def no_items():
    return L(None).cast("array<struct<tag:string,value:string>>")


def no_dims():
    return L(None).cast("array<int>")


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trees(spark, sf_dir):
    """(nodes, attrs) of the conversations: a node for each, and one for each turn below it."""
    t = _read(spark, sf_dir, "conversations")
    roots = t.select(F.concat(L("conv-"), "conv_id").alias("node_id")).distinct().select("node_id", L(None).cast("string").alias("parent_id"), L(0).cast("bigint").alias("child_pos"), L("chat/conversation").alias("kind"), L(None).cast("string").alias("name"))
    turns = t.select(F.concat(L("conv-"), "conv_id", L("-"), "turn").alias("node_id"), F.concat(L("conv-"), "conv_id").alias("parent_id"), C("turn").cast("bigint").alias("child_pos"), L("chat/turn").alias("kind"), C("role").alias("name"))
    key = F.concat(L("conv-"), "conv_id", L("-"), "turn").alias("node_id")
    attrs = t.select(key, L("role").alias("key"), L("symbol").alias("tag"), C("role").alias("value")).unionByName(
        t.select(key, L("size").alias("key"), L("integer").alias("tag"), F.length("text").cast("string").alias("value"))
    )
    return roots.unionByName(turns), attrs.withColumn("items", no_items()).withColumn("dims", no_dims())


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("g10_tree_walk", """
SELECT 'conv-' || conv_id AS node_id, 'conv-' || conv_id AS root, 0 AS depth, '0' AS path FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT 'conv-' || conv_id || '-' || turn, 'conv-' || conv_id, 1, '0/' || turn FROM conversations""")
def _(spark, sf_dir):
    return nodes.walk(trees(spark, sf_dir)[0]).withColumn("path", F.array_join(C("path").cast("array<string>"), "/"))


@query("f13_s_expressions", """
SELECT 'conv-' || conv_id AS root, '(chat/conversation' || chr(10) || string_agg('  (chat/turn ' || role || ' (role "' || role || '") (size ' || length(text) || '))' || CASE WHEN last THEN ')' ELSE '' END, chr(10) ORDER BY turn) AS text
FROM (SELECT *, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id""")
def _(spark, sf_dir):
    return nodes.s_expressions(*trees(spark, sf_dir))


@query("f17_equal_trees", """
SELECT DISTINCT 'conv-' || conv_id AS root, conv_id % 5 <> 1 AND conv_id % 7 <> 2 AND conv_id % 11 <> 3 AS equal FROM conversations""")
def _(spark, sf_dir):
    """Conversations against copies of which some have a role of another tag, some an attribute of nothing, some a turn less."""
    n, attrs = trees(spark, sf_dir)
    conv = F.split("node_id", "-")[1].cast("bigint")
    tag = F.when((conv % 5 == 1) & (C("key") == "role"), "string").otherwise(C("tag"))
    more = attrs.where((conv % 7 == 2) & (C("key") == "role")).withColumns({"key": L("void"), "tag": L("nothing"), "value": L(None).cast("string")})
    less = n.where((conv % 11 != 3) | (C("child_pos") > 0) | C("parent_id").isNull())
    return nodes.equal(n, attrs, less, attrs.withColumn("tag", tag).unionByName(more))


@query("p13_attribute", "SELECT 'conv-' || conv_id || '-' || turn AS node_id, role AS value FROM conversations")
def _(spark, sf_dir):
    return nodes.attribute(trees(spark, sf_dir)[1], "role", "nobody")


@query("f16_node_payload", "SELECT 'conv-' || conv_id || '-' || turn AS node_id, role || '/' || length(text) AS record FROM conversations")
def _(spark, sf_dir):
    return nodes.payload(trees(spark, sf_dir)[1]).select("node_id", F.concat(C("record")["role"], L("/"), C("record")["size"]).alias("record"))


def _records(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    key = F.concat(L("doc-"), "doc_id").alias("node_id")
    lang_tag = F.when(C("doc_id") % 50 == 7, "reference").when(C("doc_id") % 61 == 3, "string").otherwise("symbol")
    attrs = [
        d.where("doc_id % 37 <> 5").select(key, L("lang").alias("key"), lang_tag.alias("tag"), C("lang").alias("value")),
        d.select(key, L("low").alias("key"), L("integer").alias("tag"), (C("n_chars") % 100).cast("string").alias("value")),
        d.select(key, L("high").alias("key"), F.when(C("doc_id") % 41 == 2, "string").otherwise("integer").alias("tag"), (C("n_chars") % 90 + 5).cast("string").alias("value")),
        d.where("doc_id % 29 = 1").select(key, L("extra").alias("key"), L("string").alias("tag"), L("x").alias("value")),
    ]
    out = attrs[0]
    for x in attrs[1:]:
        out = out.unionByName(x)
    rows = d.select(key, F.when(C("doc_id") % 53 == 9, "text/page").otherwise("text/document").alias("kind"), L("text/document").alias("expected"))
    return rows, out.withColumn("items", no_items()).withColumn("dims", no_dims())


def _schemas(spark):
    rule = nodes.RULES
    attrs = spark.createDataFrame(
        [
            ("text/document", "lang", "symbol", True, True, [("one_of", None, ["en", "de"], ""), ("nonempty", None, None, "")]),
            ("text/document", "low", "integer", True, False, [("ge", "10", None, ""), ("finite", None, None, ""), ("sparkles", None, None, "")]),
            ("text/document", "high", "real", True, False, [("lt", "90", None, "too high")]),
            ("text/document", "other", "unheard", False, False, []),
        ],
        f"kind string, name string, value_kind string, required boolean, allow_ref boolean, rules {rule}",
    )
    kinds = spark.createDataFrame([("text/document", False)], "kind string, allow_extra boolean")
    over = spark.createDataFrame([("text/document", "ordered", ["low", "high"], ""), ("text/document", "balanced", ["low"], "")], "kind string, rule string, fields array<string>, message string")
    return kinds, attrs, over


@query("k16_node_schema", """
WITH r AS (SELECT 'doc-' || doc_id AS id, doc_id, lang, n_chars, n_chars % 100 AS low, n_chars % 90 + 5 AS high, doc_id % 37 <> 5 AS has_lang,
    CASE WHEN doc_id % 50 = 7 THEN 'reference' WHEN doc_id % 61 = 3 THEN 'string' ELSE 'symbol' END AS lang_tag, doc_id % 41 = 2 AS bad_high, doc_id % 53 = 9 AS bad_kind FROM documents)
SELECT 'schema_kind_mismatch' AS code, id AS subject, 'text/page' AS related FROM r WHERE bad_kind
UNION ALL SELECT 'missing_attribute', id, 'lang' FROM r WHERE NOT has_lang
UNION ALL SELECT 'attribute_type', id, 'lang' FROM r WHERE has_lang AND lang_tag = 'string'
UNION ALL SELECT 'attribute_type', id, 'high' FROM r WHERE bad_high
UNION ALL SELECT 'validation_rule_failed', id, 'lang:one_of' FROM r WHERE has_lang AND lang_tag = 'symbol' AND lang NOT IN ('en', 'de')
UNION ALL SELECT 'validation_rule_failed', id, 'low:ge' FROM r WHERE low < 10
UNION ALL SELECT 'unknown_validation_rule', id, 'low:sparkles' FROM r
UNION ALL SELECT 'validation_rule_failed', id, 'low:sparkles' FROM r
UNION ALL SELECT 'validation_rule_failed', id, 'high:lt' FROM r WHERE NOT bad_high AND high >= 90
UNION ALL SELECT 'unexpected_attribute', id, 'extra' FROM r WHERE doc_id % 29 = 1
UNION ALL SELECT 'node_validation_rule_failed', id, 'ordered' FROM r WHERE NOT bad_kind AND NOT bad_high AND high < low
UNION ALL SELECT 'unknown_node_validation_rule', id, 'balanced' FROM r WHERE NOT bad_kind""")
def _(spark, sf_dir):
    rows, attrs = _records(spark, sf_dir)
    return found(nodes.validate(rows, attrs, *_schemas(spark)))


@query("k15_payload_schema", """
SELECT 'payload_schema_violation' AS code, 'vec-' || vec_id AS subject, r AS related FROM (
  SELECT vec_id, unnest([CASE WHEN vec_id % 17 = 3 THEN 'vector:array_shape' WHEN vec_id % 19 = 4 THEN 'vector:array_rank' END, CASE WHEN vec_id % 23 = 5 THEN 'label:missing_field' WHEN vec_id % 29 = 6 THEN 'label:logical_type' WHEN label >= 5 THEN 'label:validation_rule' END,
    CASE WHEN vec_id % 31 = 7 THEN 'note:unexpected_field' END, CASE WHEN vec_id % 37 = 8 THEN 'tags:cardinality' WHEN vec_id % 41 = 9 THEN 'tags:logical_type' END, CASE WHEN vec_id % 43 = 10 THEN 'source:reference_target' END]) AS r FROM embeddings) WHERE r IS NOT NULL""")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    key = F.concat(L("vec-"), "vec_id").alias("node_id")
    real = F.transform("embedding", lambda x: F.struct(L("real").alias("tag"), x.cast("double").cast("string").alias("value")))
    v = C("vec_id")
    cut = F.when(v % 17 == 3, F.slice(real, 1, 63)).otherwise(real)
    tags = F.array(F.struct(L("string").alias("tag"), L("a").alias("value")), F.struct(F.when(v % 41 == 9, "integer").otherwise("string").alias("tag"), L("1").alias("value")))
    text = L(None).cast("string")
    parts = [
        e.select(key, L("vector").alias("key"), L("array").alias("tag"), text.alias("value"), cut.alias("items"), F.when((v % 19 == 4) & (v % 17 != 3), F.array(L(8), L(8))).otherwise(F.array(F.size(cut))).alias("dims")),
        e.where("vec_id % 23 <> 5").select(key, L("label").alias("key"), F.when(v % 29 == 6, "string").otherwise("integer").alias("tag"), C("label").cast("string").alias("value"), no_items().alias("items"), no_dims().alias("dims")),
        e.where("vec_id % 31 = 7").select(key, L("note").alias("key"), L("string").alias("tag"), L("x").alias("value"), no_items().alias("items"), no_dims().alias("dims")),
        e.select(key, L("tags").alias("key"), F.when(v % 37 == 8, "string").otherwise("list").alias("tag"), text.alias("value"), tags.alias("items"), no_dims().alias("dims")),
        e.select(key, L("source").alias("key"), F.when(v % 43 == 10, "string").otherwise("reference").alias("tag"), L("corpus").alias("value"), no_items().alias("items"), no_dims().alias("dims")),
    ]
    attrs = parts[0]
    for p in parts[1:]:
        attrs = attrs.unionByName(p)
    none = []
    fields = spark.createDataFrame(
        [
            ("vec", "vector", "real", none, 1, [64], True, "one", None, []),
            ("vec", "label", "integer", none, 0, none, True, "one", None, [("lt", "5", None, "")]),
            ("vec", "tags", "string", none, 0, none, True, "many", None, []),
            ("vec", "source", "string", none, 0, none, True, "one", "text/corpus", []),
        ],
        f"schema string, name string, element_kind string, enum_values array<string>, rank int, shape array<int>, required boolean, cardinality string, reference_target string, rules {nodes.RULES}",
    )
    return found(nodes.validate_payload(e.select(key, L("vec").alias("schema")), attrs, fields))


DEFINITIONS = """
SELECT 'ns' || (p_partkey % 25) AS schema_ns, 's' || p_partkey AS schema_id, 'v' || (p_size % 3) AS schema_version,
  'ns' || CASE WHEN p_partkey % 101 = 0 THEN (p_partkey + 1) % 25 ELSE p_partkey % 25 END AS ns_id, CASE WHEN p_partkey % 103 = 0 THEN 'uuid-x' ELSE 'uuid-' || (p_partkey % 25) END AS ns_uuid,
  CASE WHEN p_size % 5 = 0 THEN 'migration_required' ELSE 'exact_read' END AS compatibility, p_name AS documentation,
  CASE WHEN p_partkey % 7 = 0 THEN 'ns' || (p_partkey % 25) || '/s' || CASE WHEN p_partkey % 49 = 0 THEN 0 ELSE p_partkey END END AS node_kind,
  CASE WHEN p_partkey % 25 = 3 THEN 'ns3/s' || (p_partkey - 25 * (p_partkey % 2)) || '/v1' END AS replaces,
  CASE WHEN p_partkey % 25 = 3 THEN 'ns3/s' || (p_partkey + 25) || '/v' || (p_size % 3) END AS replaced_by,
  CASE WHEN p_size % 10 = 0 THEN 'ns' || (p_partkey % 25) || '/s' || CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey END || '/v' || (p_size % 3) END AS migration_source,
  CASE WHEN p_size % 10 = 0 THEN 'ns' || (p_partkey % 25) || '/s' || (p_partkey + 25) || '/v9' END AS migration_target, p_partkey AS ordinal FROM {part}
UNION ALL SELECT 'ns' || (p_partkey % 25), 's' || p_partkey, 'v' || (p_size % 3), 'ns' || (p_partkey % 25), 'uuid-' || (p_partkey % 25), 'exact_read', 'again', NULL, NULL, NULL, NULL, NULL, p_partkey + 1000000 FROM {part} WHERE p_partkey % 211 = 0"""
FIELDS = """
SELECT 'ns' || (p_partkey % 25) AS schema_ns, 's' || p_partkey AS schema_id, 'v' || (p_size % 3) AS schema_version, CASE WHEN k = 2 AND p_partkey % 53 = 0 THEN 'f1' ELSE 'f' || k END AS name, k AS pos,
  CASE WHEN k = 1 THEN 2 ELSE 0 END AS rank, CASE WHEN k = 1 THEN CASE WHEN p_partkey % 59 = 0 THEN 3 ELSE 2 END ELSE 0 END AS extents
FROM {part} CROSS JOIN (SELECT r_regionkey AS k FROM {region} WHERE r_regionkey IN (1, 2)) x WHERE p_partkey % 13 > 0"""


def _definitions(spark, sf_dir):
    part, region = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "region")
    d = spark.sql(DEFINITIONS, part=part)
    f = spark.sql(FIELDS, part=part, region=region).withColumn("shape", F.when(C("extents") == 0, F.array().cast("array<int>")).otherwise(F.array_repeat(L(1), C("extents").cast("int"))))
    return Archive({}, CONFIG), d, f


def _sql(text):
    d, f = (x.replace("{part}", "part").replace("{region}", "region") for x in (DEFINITIONS, FIELDS))
    return f"WITH d AS (SELECT *, schema_ns || '/' || schema_id || '/' || schema_version AS key, schema_ns || '/' || schema_id AS kind FROM ({d})), f AS ({f}) {text}"


UUID = "'00000000-0000-4000-8000-000000000001'"


@query("k14_schema_registry", _sql(f"""
SELECT 'schema_namespace_mismatch' AS code, key AS subject, ns_id AS related FROM d WHERE ns_id <> schema_ns
UNION ALL SELECT 'reserved_namespace_claimed', key, ns_uuid FROM d WHERE ns_id = 'ns0' AND ns_uuid NOT IN ('', {UUID})
UNION ALL SELECT 'reserved_kind_claimed', key, kind FROM d WHERE ns_id <> 'ns0' AND starts_with(kind, 'ns0/')
UNION ALL SELECT 'corrupt_schema', key, 'no_fields' FROM d WHERE node_kind IS NULL AND (schema_ns, schema_id, schema_version) NOT IN (SELECT schema_ns, schema_id, schema_version FROM f)
UNION ALL SELECT 'corrupt_schema', key, 'node_kind' FROM d WHERE node_kind <> kind
UNION ALL SELECT 'corrupt_schema', key, 'replaces_itself' FROM d WHERE coalesce(replaces = key, false) OR coalesce(replaced_by = key, false)
UNION ALL SELECT 'corrupt_schema', key, 'migration_target' FROM d WHERE migration_target <> replaced_by
UNION ALL SELECT 'missing_migration_ref', key, '' FROM d WHERE compatibility = 'migration_required' AND migration_target IS NULL
UNION ALL SELECT 'corrupt_schema', key, 'migration_source' FROM d WHERE compatibility = 'migration_required' AND migration_target IS NOT NULL AND migration_source <> key
UNION ALL SELECT 'corrupt_schema', schema_ns || '/' || schema_id || '/' || schema_version, 'shape:' || name FROM f WHERE extents > 0 AND extents <> rank
UNION ALL SELECT 'corrupt_schema', schema_ns || '/' || schema_id || '/' || schema_version, 'duplicate:' || name FROM (SELECT *, row_number() OVER (PARTITION BY schema_ns, schema_id, schema_version, name ORDER BY pos) AS n FROM f) WHERE n > 1
UNION ALL SELECT 'duplicate_schema', key, '' FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS n FROM d) WHERE n > 1
UNION ALL SELECT 'namespace_identity_conflict', ns_id, string_agg(DISTINCT ns_uuid, ',' ORDER BY ns_uuid) FROM d WHERE ns_uuid <> '' GROUP BY ns_id HAVING count(DISTINCT ns_uuid) > 1
UNION ALL SELECT 'namespace_id_split', ns_uuid, string_agg(DISTINCT ns_id, ',' ORDER BY ns_id) FROM d WHERE ns_uuid <> '' GROUP BY ns_uuid HAVING count(DISTINCT ns_id) > 1
UNION ALL SELECT 'corrupt_schema', d.key, 'successor:' || d.replaced_by FROM d JOIN (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1) o ON o.key = d.replaced_by WHERE o.replaces <> d.key
UNION ALL SELECT 'corrupt_schema', d.key, 'predecessor:' || d.replaces FROM d JOIN (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY ordinal DESC) = 1) o ON o.key = d.replaces WHERE o.replaced_by <> d.key"""))
def _(spark, sf_dir):
    return found(catalog.registry(*_definitions(spark, sf_dir)))


@query("v4_objects_against_definitions", _sql("""
, o AS (SELECT *, schema_ns || '/' || schema_id || '/' || schema_version AS key FROM ({objects}))
SELECT CASE s WHEN 'migration_required' THEN s ELSE 'missing_schema' END AS code, object_id AS subject, key AS related
FROM (SELECT object_id, o.key, coalesce(k.compatibility, 'missing_schema') AS s FROM o LEFT JOIN (SELECT key, min(compatibility) AS compatibility FROM d GROUP BY key) k ON k.key = o.key) WHERE s <> 'exact_read'""").replace("{objects}", duckdb_sql("objects")))
def _(spark, sf_dir):
    """What embedded definitions say of the objects' schemas; of repeated ones the least compatibility."""
    _, d, _ = _definitions(spark, sf_dir)
    known = d.groupBy(*catalog.KEY).agg(F.min("compatibility").alias("compatibility"))
    return found(catalog.status_diagnostics(archive(spark, sf_dir).objects, known))


@query("a3_definition_report", _sql("""
SELECT d.key AS schema, d.compatibility, coalesce(g.fields, '') AS fields, coalesce(g.n, 0) AS n_fields, 'schema ' || d.key || ' is ' || d.compatibility AS summary FROM d
LEFT JOIN (SELECT schema_ns || '/' || schema_id || '/' || schema_version AS key, string_agg(name, ',' ORDER BY name) AS fields, count(*) AS n FROM f GROUP BY 1) g ON g.key = d.key"""))
def _(spark, sf_dir):
    _, d, f = _definitions(spark, sf_dir)
    return records.definition_report(d, f)


@query("a3_registry_report", _sql("SELECT count(*) AS entries, count(DISTINCT kind) AS names FROM d"))
def _(spark, sf_dir):
    d = _definitions(spark, sf_dir)[1]
    return records.registry_report(d.withColumn("kind", F.concat_ws("/", "schema_ns", "schema_id")), "kind")


@query("a3_document_report", "SELECT 'conv-' || conv_id AS document_id, 'chat/conversation' AS schema, count(*) AS fragments FROM conversations GROUP BY conv_id")
def _(spark, sf_dir):
    t = _read(spark, sf_dir, "conversations")
    return records.document_report(t.select(F.concat(L("conv-"), "conv_id").alias("document_id"), L("chat/conversation").alias("schema")))


@query("a9_list_schemas", _sql("""
SELECT d.schema_ns, d.schema_id, d.schema_version, d.ns_id, d.compatibility, d.documentation, coalesce(g.fields, '') AS fields, coalesce(g.n, 0) AS n_fields FROM d
LEFT JOIN (SELECT schema_ns, schema_id, schema_version, string_agg(name, ',' ORDER BY name) AS fields, count(*) AS n FROM f GROUP BY ALL) g ON g.schema_ns = d.schema_ns AND g.schema_id = d.schema_id AND g.schema_version = d.schema_version"""))
def _(spark, sf_dir):
    _, d, f = _definitions(spark, sf_dir)
    return catalog.listing(d, f)
