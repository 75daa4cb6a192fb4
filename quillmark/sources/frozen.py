"""Frozen datasets: suites, base replies and reference lines, bound by hashes of their raw bytes.

Readers take explicit schemas, refuse rows with other keys, and compare hashes before anything is used.
Problems come back as a table from check_*; load_* raises on the first of them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import Rules, persona_identity
from ..operators import integrity as I

ROW_KEYS = ("id", "template", "character", "situation", "speaker", "line")
ROW = T.StructType([T.StructField(k, T.StringType(), False) for k in ROW_KEYS])
CANON_ENTRY = "array<struct<episode:string,context:string,line:string>>"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: (file, value)."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")


def read_json_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """One JSON document per file, of the given schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def suite_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of train.json and test.json with their split and the raw keys of each object."""
    text = read_text(spark, f"{folder}/{{train,test}}.json")
    items = text.select(F.regexp_replace("file", r"\.json$", "").alias("split"), F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    return items.select("split", F.map_keys("m").alias("keys"), *(F.col("m")[k].alias(k) for k in ROW_KEYS))


def freeze(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json_document(spark, path, schema)


SUITE_FREEZE = "files map<string,string>, persona_sha256 string, split string, seed int, test_templates array<string>, rows struct<train:int,test:int>, source string"


def check_suite(spark: SparkSession, folder: str, rules: Rules, personas: str | None = None) -> DataFrame:
    """(problem, detail) of a frozen suite: file set, hashes, persona, row keys, ids, split. ``personas`` is the identity
    that the freeze must name; by default that of the rules."""
    personas = persona_identity(rules) if personas is None else personas
    frozen = freeze(spark, f"{folder}/freeze.json", SUITE_FREEZE)
    wanted = frozen.select(F.explode("files").alias("file", "sha256"))
    found = I.digests(spark, f"{folder}/{{train,test}}.json")
    rows = suite_rows(spark, folder)
    known = F.array(*(F.lit(k) for k in sorted(ROW_KEYS)))
    filled = F.lit(True)
    for k in ROW_KEYS:
        filled = filled & F.col(k).isNotNull()
    problems = [
        I.hash_drift(found, wanted).select(F.col("problem"), F.col("file").alias("detail")),
        frozen.filter(~F.col("persona_sha256").eqNullSafe(personas)).select(F.lit("persona").alias("problem"), F.col("persona_sha256").alias("detail")),
        rows.filter((F.sort_array("keys") != known) | ~filled).select(F.lit("row keys").alias("problem"), F.col("id").alias("detail")),
        rows.filter(~F.col("character").isin(*(p.key for p in rules.personas))).select(F.lit("character").alias("problem"), F.col("id").alias("detail")),
        I.duplicates(rows, "id").select(F.lit("duplicate id").alias("problem"), F.col("id").alias("detail")),
        I.shared_templates(rows).select(F.lit("template in both splits").alias("problem"), F.col("template").alias("detail")),
    ]
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out


def _refuse(problems: DataFrame) -> None:
    first = problems.limit(1).collect()
    if first:
        raise ValueError(f"frozen data refused: {first[0].problem}: {first[0].detail}")


def load_suite(spark: SparkSession, folder: str, rules: Rules, personas: str | None = None) -> DataFrame:
    """Rows of both splits with their split, or an error."""
    _refuse(check_suite(spark, folder, rules, personas))
    return suite_rows(spark, folder).drop("keys")


def select_character(rows: DataFrame, rules: Rules, *characters: str) -> DataFrame:
    """Rows of the given characters, by default of all; one that the rules do not know is an error."""
    known = [p.key for p in rules.personas]
    if odd := sorted({*characters} - {*known}):
        raise ValueError(f"unknown character: {odd[0]}")
    return rows.filter(F.col("character").isin(*(characters or known)))


def base_replies(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, reply) of a JSON map."""
    return read_text(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias("row_id", "reply"))


def check_base_replies(spark: SparkSession, folder: str, suite: str, rows: DataFrame) -> DataFrame:
    """(problem, detail): reply bytes, the suite's freeze, and exact coverage of the suite's ids."""
    frozen = freeze(spark, f"{folder}/freeze.json", "replies_sha256 string, suite_freeze_sha256 string")
    one = lambda path, field: I.digests(spark, path).join(frozen).filter(F.col("sha256") != F.col(field)).select(F.lit("changed").alias("problem"), F.col("file").alias("detail"))
    kinds = read_text(spark, f"{folder}/replies.json").select(F.explode(F.from_json("value", "map<string,variant>")).alias("row_id", "v"))
    odd = kinds.filter(F.schema_of_variant("v") != "STRING").select(F.lit("not a text").alias("problem"), F.col("row_id").alias("detail"))
    cover = I.coverage(rows.select(F.col("id").alias("row_id")), base_replies(spark, f"{folder}/replies.json"), "row_id")
    return one(f"{folder}/replies.json", "replies_sha256").unionByName(one(f"{suite}/freeze.json", "suite_freeze_sha256")).unionByName(odd).unionByName(cover.select(F.col("side").alias("problem"), F.col("row_id").alias("detail")))


def load_base_replies(spark: SparkSession, folder: str, suite: str, rows: DataFrame) -> DataFrame:
    _refuse(check_base_replies(spark, folder, suite, rows))
    return base_replies(spark, f"{folder}/replies.json")


def canon(spark: SparkSession, path: str) -> DataFrame:
    """(character, position, episode, context, line) of the reference lines."""
    entries = read_text(spark, path).select(F.explode(F.from_json("value", f"map<string,{CANON_ENTRY}>")).alias("character", "entries"))
    return entries.select("character", F.posexplode("entries").alias("position", "e")).select("character", "position", "e.*")


def load_canon(spark: SparkSession, folder: str, rules: Rules) -> DataFrame:
    """Reference lines after checking hash, characters and nonempty fields."""
    frozen = freeze(spark, f"{folder}/freeze.json", "canon_sha256 string")
    lines = canon(spark, f"{folder}/canon.json")
    bad = I.digests(spark, f"{folder}/canon.json").join(frozen).filter(F.col("sha256") != F.col("canon_sha256")).select(F.lit("changed").alias("problem"), F.col("file").alias("detail"))
    empty = F.lit(False)
    for c in ("episode", "context", "line"):
        empty = empty | F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    bad = bad.unionByName(lines.filter(empty).select(F.lit("empty field").alias("problem"), F.col("character").alias("detail")))
    wanted = spark.createDataFrame([(p.key,) for p in rules.personas], "character string")
    have = lines.select("character").distinct()
    odd = have.exceptAll(wanted).unionAll(wanted.exceptAll(have))
    _refuse(bad.unionByName(odd.select(F.lit("characters").alias("problem"), F.col("character").alias("detail"))))
    return lines


def canon_identity(spark: SparkSession, path: str | None) -> str | None:
    """Hash of the reference lines' bytes; None without them."""
    return None if path is None else I.digests(spark, path).first().sha256


def build_suite(templates: DataFrame, rules: Rules, test_templates: list[str]) -> DataFrame:
    """Templates x lines x characters: ids are template-Lnumber-character, lines numbered from 1.

    ``templates``: template, situation, speaker, lines array<string>. ``test_templates`` is read from
    the freeze, not drawn again.
    """
    rows = templates.select("template", "situation", "speaker", F.posexplode("lines").alias("at", "line"))
    rows = rows.withColumn("character", F.explode(F.array(*(F.lit(p.key) for p in rules.personas))))
    ids = F.format_string("%s-L%d-%s", "template", F.col("at") + 1, "character")
    return rows.select(ids.alias("id"), "template", "character", "situation", "speaker", "line", F.when(F.col("template").isin(*test_templates), "test").otherwise("train").alias("split"))


def write_once(df: DataFrame, path: str) -> None:
    """JSON lines at a path that must not exist."""
    df.write.mode("errorifexists").json(path)


def write_document(spark: SparkSession, value, path: str) -> None:
    """One JSON document in one part file of a folder that must not exist."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def read_document(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_freeze(spark: SparkSession, files: str, out: str, **more) -> dict:
    """A manifest of a handful of files' hashes, written once and read back: an error if it or a file differs by then."""
    manifest = {"files": {r.file: r.sha256 for r in I.digests(spark, files).collect()}, **more}
    write_document(spark, manifest, out)
    back = read_document(spark, out)
    frozen = spark.createDataFrame(list(back["files"].items()), "file string, sha256 string")
    if back != json.loads(json.dumps(manifest)) or not I.hash_drift(I.digests(spark, files), frozen).isEmpty():
        raise ValueError("the freeze does not match its files")
    return manifest
