"""Message contracts between repositories: shared constants, struct shapes, direction, drift, suppression.

Relations: constants (repo, package_path, ref, name, value) and shapes (repo, package_path, type_ref, wire_name,
go_type). Pairs come from equi-joins on values, names or digests of whole shapes; the side with the lesser (repo, ref) is
the first one, so each pair comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import short_name
from graphloom.model import Graph
from graphloom.operators.lookup import enclosing

CONSTANT, SHAPE, THRESHOLD = 0.6, 0.4, 0.5
#: Parts of names that tell which side of a message a symbol is on.
PRODUCER = ("encode", "send", "publish", "write", "marshal", "put")
CONSUMER = ("decode", "receive", "subscribe", "read", "unmarshal", "get")


def constants_of(symbols: DataFrame) -> DataFrame:
    """Constants with a string value: their signature is its literal."""
    value = F.regexp_extract("signature", r'^["`](.*)["`]$', 1)
    rows = symbols.where("kind = 'const' and not is_test").select("repo", "package_path", F.col("qualified_name").alias("ref"), "name", value.alias("value"))
    return rows.where("value <> ''")


def shapes_of(symbols: DataFrame) -> DataFrame:
    """The fields of types, one row each."""
    rows = symbols.where("kind = 'type' and not is_test").select("repo", "package_path", F.col("qualified_name").alias("type_ref"), F.explode("fields").alias("f"))
    return rows.select("repo", "package_path", "type_ref", F.col("f.wire_name").alias("wire_name"), F.col("f.go_type").alias("go_type"))


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns)) for s in ("a", "b"))


def first_side(key: str = "ref") -> Column:
    """The canonical order of a cross-repository pair."""
    return (F.col("repo_a") != F.col("repo_b")) & (F.struct(F.col("repo_a"), F.col(f"{key}_a")) < F.struct(F.col("repo_b"), F.col(f"{key}_b")))


def shared_constants(constants: DataFrame) -> DataFrame:
    """Pairs of constants of different repositories with the same value."""
    a, b = sides(constants.where("value <> ''"))
    return a.join(b, F.col("value_a") == F.col("value_b")).where(first_side()).select("repo_a", "repo_b", F.col("ref_a").alias("from_ref"), F.col("ref_b").alias("to_ref"), F.col("value_a").alias("value"), "package_path_a", "package_path_b", "name_a", "name_b")


def value_drift(constants: DataFrame) -> DataFrame:
    """Constants of one name and different values, across repositories: breaking."""
    a, b = sides(constants)
    rows = a.join(b, F.col("name_a") == F.col("name_b")).where(first_side() & (F.col("value_a") != F.col("value_b")))
    return rows.select(F.col("ref_a").alias("from_ref"), F.col("ref_b").alias("to_ref"), F.lit("breaking").alias("severity"), F.col("value_a").alias("type_a"), F.col("value_b").alias("type_b"), F.lit("value_changed").alias("status"))


def name_drift(constants: DataFrame) -> DataFrame:
    """Constants of one value and different names, across repositories: unknown."""
    a, b = sides(constants)
    rows = a.join(b, F.col("value_a") == F.col("value_b")).where(first_side() & (F.col("name_a") != F.col("name_b")))
    return rows.select(F.col("ref_a").alias("from_ref"), F.col("ref_b").alias("to_ref"), F.lit("unknown").alias("severity"), F.col("value_a").alias("type_a"), F.col("value_b").alias("type_b"), F.lit("same_value_different_name").alias("status"))


def constant_drift(constants: DataFrame) -> DataFrame:
    return value_drift(constants).unionAll(name_drift(constants))


def associated(constants: DataFrame, shapes: DataFrame) -> DataFrame:
    """ref, type_ref: the struct that goes with a constant of the same package: its name without MsgType, else the least."""
    types = shapes.select("repo", "package_path", "type_ref").distinct()
    own = F.concat("package_path", F.lit("."), F.regexp_replace("name", "^MsgType", ""))
    rows = constants.join(types, ["repo", "package_path"]).withColumn("far", (F.col("type_ref") != own).cast("int"))
    return rows.groupBy("ref").agg(F.min(F.struct("far", "type_ref")).alias("m")).select("ref", F.col("m.type_ref").alias("type_ref"))


def compared(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """pairs (type_a, type_b) with a row for each wire name of either: wire_name, go_a, go_b (null where missing)."""
    wide = shapes.select("type_ref", "wire_name", "go_type").distinct()
    distinct = pairs.select("type_a", "type_b").distinct()
    a = distinct.join(wide.withColumnsRenamed({"type_ref": "type_a", "go_type": "go_a"}), "type_a")
    b = distinct.join(wide.withColumnsRenamed({"type_ref": "type_b", "go_type": "go_b"}), "type_b")
    return a.join(b, ["type_a", "type_b", "wire_name"], "full")


def shape_scores(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """type_a, type_b, matches, only_a, only_b, divergences, score, identical, severity."""
    both = F.col("go_a").isNotNull() & F.col("go_b").isNotNull()
    counts = compared(pairs, shapes).groupBy("type_a", "type_b").agg(F.count_if(both & (F.col("go_a") == F.col("go_b"))).alias("matches"), F.count_if(F.col("go_b").isNull()).alias("only_a"), F.count_if(F.col("go_a").isNull()).alias("only_b"), F.count_if(both & (F.col("go_a") != F.col("go_b"))).alias("divergences"))
    total = 2 * (F.col("matches") + F.col("divergences")) + F.col("only_a") + F.col("only_b")
    identical = (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("divergences") == 0)
    severity = F.when(identical, "compatible").when((F.col("divergences") > 0) | (F.col("only_b") > 0), "breaking").otherwise("compatible")
    return counts.withColumn("score", 2 * F.col("matches") / total).withColumn("identical", identical).withColumn("severity", severity)


def name_direction(a: Column, b: Column) -> Column:
    """Producer, consumer or shared, from the hints in two short names."""
    has = lambda c, hints: F.lower(short_name(c)).rlike("|".join(hints))
    return F.when(has(a, PRODUCER) & has(b, CONSUMER), "producer").when(has(a, CONSUMER) & has(b, PRODUCER), "consumer").otherwise("shared")


def constant_uses(g: Graph) -> DataFrame:
    """ref, file, line, enclosing, text: the lines of a constant's package that hold its short name, and what they are in.

    Files belong to the package of the symbols declared in them. Lines meet the names of their own package only.
    """
    names = constants_of(g.symbols).select("package_path", "ref", "name").distinct()
    homes = g.symbols.select(F.col("pos_file").alias("file"), "package_path").where("file <> ''").groupBy("file").agg(F.min("package_path").alias("package_path"))
    homes = homes.join(names.select("package_path").distinct(), "package_path", "left_semi")
    files = g.files.select(F.col("path").alias("file"), "content").join(homes, "file")
    lines = files.select("file", "package_path", F.posexplode(F.split("content", "\n")).alias("k", "text")).withColumn("line", F.col("k") + 1)
    rows = lines.join(names, "package_path").where(F.contains("text", F.col("name")))
    return rows.join(enclosing(rows, g.symbols), ["file", "line"]).select("ref", "file", "line", "enclosing", "text")


def site_roles(uses: DataFrame) -> DataFrame:
    """ref, role: the role of a constant's last use. uses: ref, file, line, enclosing, text.

    A use inside of the constant's own declaration or outside of any is none. Producer hints are looked for first.
    """
    text = F.lower(F.concat_ws(" ", "enclosing", "text"))
    role = F.when(text.rlike("|".join(PRODUCER)), "producer").when(text.rlike("|".join(CONSUMER)), "consumer").otherwise("")
    rows = uses.where((F.col("enclosing") != F.col("ref")) & (F.col("enclosing") != F.col("file")))
    return rows.groupBy("ref").agg(F.max_by(role, F.struct("line", "file")).alias("role"))


def contracts(constants: DataFrame, shapes: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """from_ref, to_ref, direction, confidence, severity, suggested: shared constants and their shapes, then mere shapes.

    A shared constant is worth 0.6 and a shape without a type divergence 0.4. Identical shapes of packages that share no
    constant are suggested.
    """
    pairs = shared_constants(constants)
    types = associated(constants, shapes)
    named = pairs.join(types.withColumnsRenamed({"ref": "from_ref", "type_ref": "type_a"}), "from_ref", "left").join(types.withColumnsRenamed({"ref": "to_ref", "type_ref": "type_b"}), "to_ref", "left")
    known = named.where("type_a is not null and type_b is not null")
    rows = named.join(shape_scores(known, shapes).select("type_a", "type_b", "divergences", "severity"), ["type_a", "type_b"], "left")
    confidence = F.round(F.lit(CONSTANT) + F.when(F.col("divergences") == 0, SHAPE).otherwise(0.0), 6)
    direction = name_direction(F.col("from_ref"), F.col("to_ref"))
    if roles is not None:
        rows = rows.join(roles.withColumnsRenamed({"ref": "from_ref", "role": "role_a"}), "from_ref", "left").join(roles.withColumnsRenamed({"ref": "to_ref", "role": "role_b"}), "to_ref", "left")
        direction = F.when((F.col("role_a") == "producer") & (F.col("role_b") == "consumer"), "producer").when((F.col("role_a") == "consumer") & (F.col("role_b") == "producer"), "consumer").otherwise(direction)
    found = rows.select("from_ref", "to_ref", direction.alias("direction"), confidence.alias("confidence"), F.coalesce("severity", F.lit("unknown")).alias("severity"), (confidence < THRESHOLD).alias("suggested"))
    return found.unionByName(suggested(constants, shapes))


def suggested(constants: DataFrame, shapes: DataFrame) -> DataFrame:
    """Identical shapes of different repositories whose packages share no constant value.

    Shapes meet on a digest of their sorted fields: no pair that differs is built.
    """
    whole = shapes.select("repo", "package_path", "type_ref", "wire_name", "go_type").distinct().groupBy("repo", "package_path", "type_ref").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("wire_name", "go_type")))), 256).alias("digest"))
    a, b = sides(whole)
    pairs = a.join(b, F.col("digest_a") == F.col("digest_b")).where((F.col("repo_a") != F.col("repo_b")) & (F.col("type_ref_a") < F.col("type_ref_b")))
    linked = shared_constants(constants).select("package_path_a", "package_path_b")
    both = linked.unionAll(linked.select("package_path_b", "package_path_a")).distinct()
    rows = pairs.join(both, ["package_path_a", "package_path_b"], "left_anti")
    return rows.select(F.col("type_ref_a").alias("from_ref"), F.col("type_ref_b").alias("to_ref"), F.lit("shared").alias("direction"), F.lit(SHAPE).alias("confidence"), F.lit("compatible").alias("severity"), F.lit(True).alias("suggested"))


def shape_drift(constants: DataFrame, shapes: DataFrame) -> DataFrame:
    """type_a, type_b, wire_name, from_type, to_type, status, severity for the types of shared constants that differ.

    If both sides have fields of their own, only renames are told: those of one type are paired in the order of their
    names on either side. Else removed, added and type_changed fields are.
    """
    types = associated(constants, shapes)
    pairs = shared_constants(constants).join(types.withColumnsRenamed({"ref": "from_ref", "type_ref": "type_a"}), "from_ref").join(types.withColumnsRenamed({"ref": "to_ref", "type_ref": "type_b"}), "to_ref").select("type_a", "type_b").distinct()
    scores = shape_scores(pairs, shapes).where(~F.col("identical"))
    rows = compared(pairs, shapes).join(scores.select("type_a", "type_b", "only_a", "only_b", "severity"), ["type_a", "type_b"])
    split = (F.col("only_a") > 0) & (F.col("only_b") > 0)
    status = F.when(F.col("go_b").isNull(), "removed").when(F.col("go_a").isNull(), "added").when(F.col("go_a") != F.col("go_b"), "type_changed")
    plain = rows.where(~split).withColumn("status", status).where("status is not null").select("type_a", "type_b", "wire_name", F.coalesce("go_a", F.lit("")).alias("from_type"), F.coalesce("go_b", F.lit("")).alias("to_type"), "status", "severity")
    turn = lambda c: F.row_number().over(Window.partitionBy("type_a", "type_b", c).orderBy("wire_name"))
    gone = rows.where(split & F.col("go_b").isNull()).select("type_a", "type_b", "severity", F.col("wire_name").alias("was"), F.col("go_a").alias("go"), turn("go_a").alias("turn"))
    new = rows.where(split & F.col("go_a").isNull()).select("type_a", "type_b", F.col("wire_name").alias("now"), F.col("go_b").alias("go"), turn("go_b").alias("turn"))
    renamed = gone.join(new, ["type_a", "type_b", "go", "turn"]).select("type_a", "type_b", F.concat("was", F.lit(" → "), "now").alias("wire_name"), F.col("go").alias("from_type"), F.col("go").alias("to_type"), F.lit("renamed").alias("status"), "severity")
    return plain.unionAll(renamed)


def all_drift(constants: DataFrame, shapes: DataFrame) -> DataFrame:
    """from_ref, to_ref, severity, field, type_a, type_b, status: drifted constants (no field), and fields of types."""
    names = constant_drift(constants).select("from_ref", "to_ref", "severity", F.lit("").alias("field"), "type_a", "type_b", "status")
    fields = shape_drift(constants, shapes)
    return names.unionAll(fields.select(F.col("type_a").alias("from_ref"), F.col("type_b").alias("to_ref"), "severity", F.col("wire_name").alias("field"), F.col("from_type").alias("type_a"), F.col("to_type").alias("type_b"), "status"))


def unsuppressed(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """rows (from_ref, to_ref) without the suppressed pairs, in either direction."""
    pairs = suppressions.select("from_ref", "to_ref")
    both = pairs.unionAll(pairs.select("to_ref", "from_ref")).distinct()
    return rows.join(both, ["from_ref", "to_ref"], "left_anti")


def read_contracts(contracts: DataFrame, suppressions: DataFrame, repo: str | None = None, direction: str | None = None, severity: str | None = None, least: float | None = None) -> DataFrame:
    """Contracts by filter, without suppressed ones."""
    for column, value in (("repo", repo), ("direction", direction), ("severity", severity)):
        if value:
            contracts = contracts.where(F.col(column) == value)
    if least is not None:
        if not 0 <= least <= 1:
            raise ValueError("least must be 0 to 1")
        contracts = contracts.where(F.col("confidence") >= least)
    return unsuppressed(contracts, suppressions)
