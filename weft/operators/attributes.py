"""Attributes of atoms checked against a schema by kind: known ones cast, unknown ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that a schema may name, and the cast each one gets; values of other types stay as text.
CASTS = {"number": "double", "flag": "boolean", "date": "date"}


def attributes_of(schema: DataFrame) -> DataFrame:
    """(source_kind, attributes): each kind's rows, required ones first, then by relationship."""
    row = F.struct((~F.coalesce("is_required", F.lit(False))).alias("optional"), "relationship", "target_attribute", "use_case", F.coalesce("is_required", F.lit(False)).alias("is_required"))
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(r["relationship"].alias("relationship"), r["target_attribute"].alias("target_attribute"), r["use_case"].alias("use_case"), r["is_required"].alias("is_required")))
    return schema.groupBy("source_kind").agg(listed.alias("attributes"))


def checked(atoms: DataFrame, schema: DataFrame) -> DataFrame:
    """(id, is_object, numbers, flags, dates, texts, unknown, wrong, missing) of each atom (id, kind, payload).

    ``payload`` is JSON; what is no JSON object has no attributes.  A name that the kind's schema
    (source_kind, relationship, value_type, is_required) lacks goes to ``unknown`` as JSON text, a value that its type
    can't take to ``wrong`` by name, and required names without a sound value to ``missing``.  Nulls count as absent.
    The payload is parsed once, into a map of VARIANTs; its entries meet the kind's rules (a few rows a kind, joined by
    it) within the atom's row, so no atom is taken apart and gathered again.
    """
    rule = F.struct(F.coalesce("value_type", F.lit("text")).alias("type"), F.coalesce("is_required", F.lit(False)).alias("required"))
    rules = schema.groupBy(F.col("source_kind").alias("kind")).agg(F.map_from_entries(F.collect_list(F.struct("relationship", rule.alias("rule")))).alias("rules"))
    parsed = atoms.select("id", "kind", F.try_parse_json("payload").alias("v"))
    parsed = parsed.withColumn("is_object", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    entries = F.map_entries(F.when(F.col("is_object"), F.try_variant_get("v", "$", "map<string,variant>")))
    met = parsed.join(F.broadcast(rules), "kind", "left").select("id", "is_object", "rules", F.sort_array(F.map_keys("rules")).alias("names"), F.filter(entries, lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"])).alias("entries"))
    kind = lambda e: F.coalesce(F.try_element_at("rules", e["key"])["type"], F.lit(""))  # noqa: E731  # empty: no rule
    cast = {t: (lambda v, to=to: F.try_variant_get(v, "$", to)) for t, to in CASTS.items()}
    as_text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))

    def told(e: Column) -> Column:
        sound = F.lit(True)
        for t, f in cast.items():
            sound = F.when(kind(e) == t, f(e["value"]).isNotNull()).otherwise(sound)
        return F.struct(e["key"].alias("name"), e["value"].alias("value"), kind(e).alias("type"), sound.alias("sound"))

    each = met.withColumn("told", F.transform("entries", told))
    pairs = lambda when, value: F.map_from_entries(F.array_sort(F.transform(F.filter("told", when), lambda x: F.struct(x["name"].alias("name"), value(x["value"]).alias("v"))), lambda a, b: F.when(a["name"] < b["name"], -1).otherwise(1)))
    names = lambda when: F.sort_array(F.transform(F.filter("told", when), lambda x: x["name"]))
    typed = lambda t: lambda x: (x["type"] == t) & x["sound"]
    known = lambda x: x["type"] != ""
    empty = lambda c, t: F.coalesce(c, F.create_map().cast(f"map<string,{t}>"))
    none = F.array().cast("array<string>")
    needed = F.filter("names", lambda n: F.try_element_at("rules", n)["required"])
    columns = {f"{t}s": (empty(pairs(typed(t), f), CASTS[t])) for t, f in cast.items()}
    columns["texts"] = empty(pairs(lambda x: known(x) & ~x["type"].isin(list(CASTS)), as_text), "string")
    columns["unknown"] = empty(pairs(lambda x: ~known(x), F.to_json), "string")
    return each.select(
        "id", "is_object", *(columns[c].alias(c) for c in ("numbers", "flags", "dates", "texts", "unknown")), F.coalesce(names(lambda x: known(x) & ~x["sound"]), none).alias("wrong"),
        F.array_except(F.coalesce(needed, none), F.coalesce(names(lambda x: known(x) & x["sound"]), none)).alias("missing"),
    )
