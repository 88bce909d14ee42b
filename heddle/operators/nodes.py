"""Trees as tables: walks, and checks of nodes and payloads against schemas that are data.

nodes: (node_id, parent_id, child_pos, kind, name). attrs: (node_id, key, tag, value, items, dims), where items are the tagged
elements of lists and arrays and dims an array's extents. attr_schemas: (kind, name, value_kind, required, allow_ref, rules),
node_schemas: (kind, allow_extra), node_rules: (kind, rule, fields, message).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import diagnostic, union
from ..staging import stage

C, L = F.col, F.lit
RULES = "array<struct<kind:string,value:string,values:array<string>,message:string>>"


def walk(nodes: DataFrame) -> DataFrame:
    """(node_id, root, depth, path): every node's place below its root, as an array of positions; ordering by (root, path) is
    pre-order.

    A round for each level; a node that hangs below itself is on no path and is left out.
    """
    step = F.array(C("child_pos").cast("long"))
    level = stage(nodes.where("parent_id IS NULL").select("node_id", C("node_id").alias("root"), L(0).alias("depth"), step.alias("path")), "walk")
    seen = [level]
    while not level.isEmpty():
        below = nodes.select("node_id", "parent_id", step.alias("_s")).join(level.select(C("node_id").alias("parent_id"), "root", "depth", "path"), "parent_id")
        level = stage(below.select("node_id", "root", (C("depth") + 1).alias("depth"), F.concat("path", "_s").alias("path")), "walk")
        seen.append(level)
    return union(seen)


def s_expressions(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """(root, text): each tree as nested lists, a node a line, indented by its depth, with its attributes sorted by name.

    A tree's lines meet in one row, so trees must fit in memory; there is no bound on how many there are.
    """
    shown = F.when(C("tag").isin("string", "symbol", "reference"), F.concat(L('"'), F.replace(C("value"), L('"'), L('\\"')), L('"'))).otherwise(C("value"))
    pairs = attrs.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", F.concat(L("("), C("key"), L(" "), shown, L(")")).alias("t")))), lambda x: x["t"]), " ").alias("_a"))
    rows = walk(nodes).join(nodes.select("node_id", "kind", "name"), "node_id").join(pairs, "node_id", "left")
    line = F.concat(F.expr("repeat('  ', depth)"), L("("), C("kind"), F.when(C("name").isNotNull(), F.concat(L(" "), C("name"))).otherwise(L("")), F.when(C("_a").isNotNull(), F.concat(L(" "), C("_a"))).otherwise(L("")))
    lines = rows.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("path", "depth", line.alias("t")))).alias("l"))
    # a line closes as many lists as the next one lies higher
    after = F.transform("l", lambda x, i: F.concat(x["t"], F.repeat(L(")"), x["depth"] - F.coalesce(F.get(C("l"), i + 1)["depth"], L(0)) + 1)))
    return lines.select("root", F.array_join(after, "\n").alias("text"))


def attribute(attrs: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """(node_id, value) of one attribute for all nodes that have any."""
    return attrs.groupBy("node_id").agg(F.coalesce(F.max(F.when(C("key") == key, C("value"))), L(default)).alias("value"))


def set_attribute(attrs: DataFrame, changes: DataFrame) -> DataFrame:
    """Attributes after `changes` (same columns): values are replaced or added."""
    return attrs.join(changes, ["node_id", "key"], "left_anti").unionByName(changes)


def add_children(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after `new` ones (node_id, parent_id, kind, name) are put behind their parents' children, in order of their ids."""
    from pyspark.sql import Window

    last = nodes.groupBy("parent_id").agg((F.max("child_pos") + 1).alias("_last"))
    place = F.coalesce("_last", L(0)) + F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id")) - 1
    return nodes.unionByName(new.join(last, "parent_id", "left").withColumn("child_pos", place.cast("bigint")).select(*nodes.columns))


def payload(attrs: DataFrame) -> DataFrame:
    """(node_id, record): a node's attributes as one map of names to texts."""
    return attrs.groupBy("node_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("record"))


def equal(a_nodes: DataFrame, a_attrs: DataFrame, b_nodes: DataFrame, b_attrs: DataFrame) -> DataFrame:
    """(root, equal): whether trees with the same root are equal: kind, name and tagged attributes of each node, children in
    order. Nodes are compared by their place, so no tree meets in one row."""

    def rows(nodes, attrs, side):
        own = attrs.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("key", "tag", "value", "items", "dims"))).alias("attrs"))
        whole = walk(nodes).join(nodes.select("node_id", "kind", "name"), "node_id").join(own, "node_id", "left")
        return whole.select("root", "path", F.struct("kind", "name", "attrs").alias(side))

    both = rows(a_nodes, a_attrs, "_a").join(rows(b_nodes, b_attrs, "_b"), ["root", "path"], "full")
    return both.groupBy("root").agg(F.bool_and(C("_a").eqNullSafe(C("_b"))).alias("equal"))


SCRIPT = "core/script"


def script(spark, node_id: str, name: str, *, source: str, language: str, inputs=(), outputs=(), effects=()) -> tuple[DataFrame, DataFrame]:
    """(nodes, attrs) of one script: an opaque text with the nodes that it reads and the names of what it makes and does. It is
    never run."""
    if not source.strip():
        raise ValueError("a script needs a source")
    for what, names in (("inputs", inputs), ("outputs", outputs), ("effects", effects)):
        if not all(isinstance(x, str) and x for x in names):
            raise ValueError(f"a script's {what} must be names")
    lists = {"effects": ("symbol", effects), "inputs": ("reference", inputs), "outputs": ("symbol", outputs)}
    rows = [(node_id, k, "list", None, [(tag, x) for x in names], None) for k, (tag, names) in lists.items()]
    rows += [(node_id, "language", "symbol", language, None, None), (node_id, "source", "string", source, None, None)]
    attrs = spark.createDataFrame(rows, "node_id string, key string, tag string, value string, items array<struct<tag:string,value:string>>, dims array<int>")
    return spark.createDataFrame([(node_id, None, 0, SCRIPT, name)], "node_id string, parent_id string, child_pos long, kind string, name string"), attrs


def validated(nodes: DataFrame, attrs: DataFrame, node_schemas: DataFrame, attr_schemas: DataFrame, node_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and attributes as they are, if nothing is wrong with them; else the first messages are raised."""
    wrong = [f"{r['subject']}: {r['message']}" for r in validate(nodes, attrs, node_schemas, attr_schemas, node_rules).orderBy("subject", "code", "related").limit(20).collect()]
    if wrong:
        raise ValueError("invalid nodes: " + "; ".join(wrong))
    return nodes, attrs


def validate(nodes: DataFrame, attrs: DataFrame, node_schemas: DataFrame, attr_schemas: DataFrame, node_rules: DataFrame) -> DataFrame:
    """Checks nodes, each with an `expected` schema kind, against node schemas; `related` names the attribute or rule."""
    rows = nodes.select("node_id", "kind", "expected")
    wrong = diagnostic(rows.where("kind <> expected"), "schema_kind_mismatch", "node_id", "kind", "expected node kind {expected}, got {kind}")
    fields = attr_schemas.withColumnRenamed("kind", "expected")
    wanted = rows.join(fields, "expected")
    have = attrs.select("node_id", C("key").alias("name"), "tag", "value")
    both = wanted.join(have, ["node_id", "name"], "left")
    missing = diagnostic(both.where("tag IS NULL AND required"), "missing_attribute", "node_id", "name", "missing required attribute {name}")
    there = both.where("tag IS NOT NULL").withColumn("deferred", (C("tag") == "reference") & C("allow_ref")).withColumn("fits", values.of_kind(C("tag"), C("value_kind")))
    strange = diagnostic(there.where("NOT deferred AND fits IS NULL"), "unknown_value_kind", "node_id", "name", "unknown portable schema value kind {value_kind}")
    ill = diagnostic(there.where("NOT deferred AND NOT fits"), "attribute_type", "node_id", "name", "attribute {name} must be {value_kind}, got {tag}")
    tried = there.where("NOT deferred AND fits").select("node_id", "name", "tag", "value", F.explode("rules").alias("r"))
    known = values.known_rule(C("r.kind"))
    good = values.passes(C("r.kind"), C("tag"), C("value"), C("r.value"), C("r.values"))
    tried = tried.withColumn("rule", C("r.kind")).withColumn("good", good)
    unknown = diagnostic(tried.where(~known), "unknown_validation_rule", "node_id", F.concat_ws(":", "name", "rule"), "unknown validation rule {rule}")
    said = F.when(F.coalesce(C("r.message"), L("")) != "", C("r.message")).otherwise(values.default_message(C("r.kind"), C("name"), C("r.value"), C("r.values")))
    failed = diagnostic(tried.where(~C("good")).withColumn("said", said), "validation_rule_failed", "node_id", F.concat_ws(":", "name", "rule"), "{said}")
    closed = rows.join(node_schemas.where("NOT allow_extra").select(C("kind").alias("expected")), "expected", "left_semi")
    extra = closed.join(have, "node_id").join(fields.select("expected", "name"), ["expected", "name"], "left_anti")
    unexpected = diagnostic(extra, "unexpected_attribute", "node_id", "name", "unexpected attribute {name}")
    # rules over several attributes apply where all of them are there, well typed and no references
    ready = there.where("NOT deferred AND fits").select("node_id", "name").unionByName(extra_ready(rows, have, fields))
    maps = have.join(ready, ["node_id", "name"], "left_semi").groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("record"))
    over = rows.where("kind = expected").join(node_rules.withColumnRenamed("kind", "expected"), "expected").join(maps, "node_id", "left")
    over = over.where(F.forall("fields", lambda f: F.coalesce(F.map_contains_key(C("record"), f), L(False))))
    lost = diagnostic(over.where(~values.known_node_rule(C("rule"))), "unknown_node_validation_rule", "node_id", "rule", "unknown node validation rule {rule}")
    empty = (C("rule") == "ordered") & (F.size("fields") == 0)
    bare = diagnostic(over.where(empty), "unknown_node_validation_rule", "node_id", "rule", "ordered node rule requires fields")
    passed = values.node_passes(C("rule"), C("record"), C("fields"))
    said = F.when(F.coalesce(C("message"), L("")) != "", C("message")).otherwise(F.concat(L("attributes "), F.array_join("fields", " <= "), L(" must be ordered")))
    broken = diagnostic(over.where(values.known_node_rule(C("rule")) & ~empty).where(~passed).withColumn("said", said), "node_validation_rule_failed", "node_id", "rule", "{said}")
    return union([wrong, missing, strange, ill, unknown, failed, unexpected, lost, bare, broken])


def extra_ready(rows: DataFrame, have: DataFrame, fields: DataFrame) -> DataFrame:
    """Attributes outside the schema that rules over several may still name: those that are no references."""
    free = rows.select("node_id", "expected").join(have, "node_id").where("tag <> 'reference'")
    return free.join(fields.select("expected", "name"), ["expected", "name"], "left_anti").select("node_id", "name")


def validate_payload(records: DataFrame, attrs: DataFrame, fields: DataFrame) -> DataFrame:
    """Checks records (node_id, schema) against schema fields (schema, name, element_kind, enum_values, rank, shape, required,
    cardinality, reference_target, rules); `related` is `field:reason`."""
    wanted = records.join(fields, "schema")
    have = attrs.select("node_id", C("key").alias("name"), "tag", "value", "items", "dims")
    both = wanted.join(have, ["node_id", "name"], "left")

    def wrong(rows, reason, message):
        return diagnostic(rows, "payload_schema_violation", "node_id", F.concat(C("name"), L(":" + reason)), message)

    missing = wrong(both.where("tag IS NULL AND required"), "missing_field", "missing required field {name}")
    free = records.join(have, "node_id").join(fields.select("schema", "name"), ["schema", "name"], "left_anti")
    unexpected = wrong(free, "unexpected_field", "unexpected field {name}")
    there = both.where("tag IS NOT NULL")
    many = C("cardinality") == "many"
    listed = C("tag").isin("list", "array", "tuple")
    unlisted = wrong(there.where(many & ~listed), "cardinality", "field {name} must be a list")
    single = there.where(~many).select("node_id", "name", "element_kind", "enum_values", "rank", "shape", "reference_target", "rules", "tag", "value", "items", "dims")
    each = there.where(many & listed).select("node_id", "name", "element_kind", "enum_values", "rank", "shape", "reference_target", "rules", F.explode("items").alias("i"))
    each = each.select("node_id", "name", "element_kind", "enum_values", "rank", "shape", "reference_target", "rules", C("i.tag").alias("tag"), C("i.value").alias("value"), L(None).cast(single.schema["items"].dataType).alias("items"), L(None).cast("array<int>").alias("dims"))
    element = single.unionByName(each)
    refs = wrong(element.where("reference_target IS NOT NULL AND tag <> 'reference'"), "reference_target", "field {name} must be a logical reference to {reference_target}")
    plain = element.where("reference_target IS NULL")
    scalar = plain.where("rank = 0").withColumn("fits", values.of_type(C("tag"), C("value"), C("element_kind"), C("enum_values")))
    ill = wrong(scalar.where("NOT fits"), "logical_type", "field {name} must be {element_kind}, got {tag}")
    tried = scalar.where("fits").select("node_id", "name", "tag", "value", F.explode("rules").alias("r")).withColumn("rule", C("r.kind"))
    good = values.passes(C("r.kind"), C("tag"), C("value"), C("r.value"), C("r.values"))
    unknown = diagnostic(tried.where(~values.known_rule(C("r.kind"))), "unknown_validation_rule", "node_id", F.concat_ws(":", "name", "rule"), "unknown validation rule {rule}")
    failed = wrong(tried.where(~good), "validation_rule", "field {name} failed validation rule {rule}")
    arrays = plain.where("rank > 0").withColumn("shaped", F.coalesce((C("tag") == "array") & (F.size("dims") == C("rank")), L(False)))
    flat = wrong(arrays.where("NOT shaped"), "array_rank", "field {name} must be a rank-{rank} array")
    shaped = arrays.where("shaped")
    off = shaped.select("node_id", "name", F.explode(F.arrays_zip(C("shape").alias("want"), C("dims").alias("got"))).alias("d")).where("d.want IS NOT NULL AND d.got <> d.want")
    extents = wrong(off, "array_shape", "field {name} has a dimension of another extent")
    odd = shaped.where(F.exists("items", lambda i: ~values.of_type(i["tag"], i["value"], C("element_kind"), C("enum_values"))))
    elements = wrong(odd, "logical_type", "field {name} elements must be {element_kind}")
    return union([missing, unexpected, unlisted, refs, ill, unknown, failed, flat, extents, elements])
