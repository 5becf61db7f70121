"""Parameters between flat and nested form: a schema fence for patches, implied flags, routing of decided keys, and projections.

Nested parameters are a map of stages to maps of keys to JSON texts, so that every value keeps its type. All functions are
expressions over the row: schemas and registries are small literals of the plan, and nothing is joined or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.patches import merge_deep
from tessera.operators.toning import bound

NESTED = "map<string,map<string,string>>"


@dataclass(frozen=True)
class Field:
    """What a key of a stage takes: kind float, int, bool, str, float_or_str, dict or any; a range for numbers; choices of texts."""

    kind: str = "float"
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


Schemas = Mapping[str, Mapping[str, Field]]
# Keys that name files, the parts of a curve object, and what a temperature or tint implies.
PATH_ENDINGS, CURVE_PARTS, BALANCE = ("_path", "_file"), ("rgb", "red", "green", "blue", "luminance"), "whitebalance"
PATH_SHAPE = r"^[~/\\]|[/\\]|^\.\.?[/\\]|^[A-Za-z]:"
LONGEST_PATH = 4096


def _bad_number(number: Column, field: Column) -> Column:
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(~F.coalesce(finite, F.lit(False)), "finite").when((number < field["low"]) | (number > field["high"]), "range")


def bad_value(key: Column, text: Column, field: Column) -> Column:
    """Why a key's JSON text can't be taken by its field (a struct kind, low, high, choices), null if it can.

    path: a key that names a file, or a text that looks like a path; type, finite, range and choice by the field; curve: an object
    where numbers or texts belong that isn't a curve (parts to lists of points). JSON null always passes: it takes a value back.
    """

    def judged(value: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
        word, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        is_word, is_flag, is_null = kind == "STRING", kind == "BOOLEAN", kind == "VOID"
        is_number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT")
        is_object, is_list = kind.startswith("OBJECT"), kind.startswith("ARRAY")
        trimmed = F.trim(word)
        path = F.lower(key).rlike("(" + "|".join(map(re.escape, PATH_ENDINGS)) + ")$") | F.coalesce(is_word & (F.length(trimmed) <= LONGEST_PATH) & trimmed.rlike(PATH_SHAPE), F.lit(False))
        wanted = field["kind"]
        parts = F.json_object_keys(text)
        curve = (F.size(parts) == 0) | (F.forall(parts, lambda p: p.isin(*CURVE_PARTS)) & F.forall(parts, lambda p: F.call_function("get_json_object", text, F.concat(F.lit("$."), p)).rlike(r"^\[\s*\[")))
        wrong = F.when(wanted.isin("float", "int") & ~is_number, "type").when((wanted == "bool") & ~is_flag, "type").when((wanted == "str") & ~is_word, "type").when((wanted == "dict") & ~is_object, "type")
        wrong = wrong.when((wanted == "float_or_str") & ~(is_number | is_word | is_list | is_object), "type").when((wanted == "float_or_str") & is_object & ~F.coalesce(curve, F.lit(False)), "curve")
        measured = F.when(wanted.isin("float", "int", "float_or_str") & is_number, _bad_number(number, field))
        chosen = F.when((F.size(field["choices"]) > 0) & ~F.coalesce(F.array_contains(field["choices"], word), F.lit(False)), "choice")
        return F.when(path, "path").when(is_null, None).when(kind == "", "type").otherwise(F.coalesce(wrong, measured, chosen))

    return bound(F.try_parse_json(text), judged)


def _fields(schemas: Schemas) -> Column:
    def one(f: Field) -> Column:
        return F.struct(F.lit(f.kind).alias("kind"), F.lit(f.low).cast("double").alias("low"), F.lit(f.high).cast("double").alias("high"), F.array(*map(F.lit, f.choices)).cast("array<string>").alias("choices"))

    return F.create_map(*[x for stage, fields in schemas.items() for key, f in fields.items() for x in (F.lit(f"{stage}.{key}"), one(f))])


def violations(patch: Column, schemas: Schemas) -> Column:
    """All violations of a nested patch, an array of (stage, key, reason) by stage and key: unknown_stage, unknown_key, and those of
    bad_value(). A stage with a null map, and a null patch, take nothing back and have none; stages are texts without two
    underscores in front."""
    fields, stages = _fields(schemas), list(schemas)

    def of_stage(stage: Column, keys: Column) -> Column:
        def of_key(entry: Column) -> Column:
            field = F.try_element_at(fields, F.concat_ws(".", stage, entry["key"]))
            unknown = F.when(field.isNull(), "unknown_key")
            named = F.lower(entry["key"]).rlike("(" + "|".join(map(re.escape, PATH_ENDINGS)) + ")$")
            reason = F.when(named, "path").otherwise(F.coalesce(unknown, F.when(entry["value"].isNotNull(), bad_value(entry["key"], entry["value"], field))))
            return F.struct(stage.alias("stage"), entry["key"].alias("key"), reason.alias("reason"))

        known = F.array_sort(F.map_entries(keys))
        stranger = F.array(F.struct(stage.alias("stage"), F.lit("").alias("key"), F.lit("unknown_stage").alias("reason")))
        return F.when(~stage.isin(*stages), stranger).otherwise(F.coalesce(F.filter(F.transform(known, of_key), lambda v: v["reason"].isNotNull()), F.array()))

    found = F.flatten(F.transform(F.array_sort(F.map_keys(patch)), lambda s: of_stage(s, F.try_element_at(patch, s))))
    return F.coalesce(found, F.array().cast("array<struct<stage:string,key:string,reason:string>>"))


def implied(patch: Column, schemas: Schemas) -> Column:
    """A nested patch with the flags that its keys mean: `enabled` for stages that have such a key and get another one, and mode
    "manual" for a white balance that gets a temperature or tint. What is given stays; empty and unknown stages stay as they are."""
    gated = [s for s, fields in schemas.items() if "enabled" in fields]

    def whole(stage: Column, keys: Column) -> Column:
        def with_(flags: Column, name: str, text: str, when: Column) -> Column:
            add = F.coalesce(when, F.lit(False)) & ~F.map_contains_key(flags, name)
            return F.when(add, F.map_concat(flags, F.create_map(F.lit(name), F.lit(text)))).otherwise(flags)

        some = F.size(keys) > 0
        out = with_(keys, "enabled", "true", some & stage.isin(*gated) & (F.size(F.map_filter(keys, lambda k, v: k != "enabled")) > 0)) if gated else keys
        tuned = F.coalesce(F.try_element_at(keys, F.lit("temp")), F.lit("null")) != "null"
        tuned = tuned | (F.coalesce(F.try_element_at(keys, F.lit("tint")), F.lit("null")) != "null")
        return with_(out, "mode", '"manual"', (stage == BALANCE) & tuned) if BALANCE in schemas else out

    return F.transform_values(patch, whole)


@dataclass(frozen=True)
class Routes:
    """Where flat decided keys go: names for the exposure's offset, dotted names to (stage, key), stages that a key switches on, and
    limits of regional keys."""

    exposure: Sequence[str] = ("exposure_ev", "ev")
    slots: Mapping[str, tuple[str, str]] | None = None
    switched: Sequence[tuple[str, str]] = ()
    region_limits: Mapping[str, float] | None = None


def routed(params: Column, decided: Column, routes: Routes) -> Column:
    """A struct (params, regions, other): flat decided values (a map of names to numbers) put where they are carried out.

    Names are read without regard to case. The exposure's offset goes with mode "auto"; names of `slots` to their stage and key,
    switching it on where `switched` says so; `region.<name>.<key>` to regions[name][key], held to its limit, with region_adjust
    switched on; all others stay as `other`. Null values go nowhere. Decided keys overwrite; whatever else is in params stays.
    """
    entries = F.filter(F.map_entries(decided), lambda e: e["value"].isNotNull())
    slots, limits = dict(routes.slots or {}), dict(routes.region_limits or {})
    pair = "struct<stage:string,key:string,value:string>"

    def cell(stage: str | Column, key: str | Column, value: Column) -> Column:
        return F.struct((F.lit(stage) if isinstance(stage, str) else stage).alias("stage"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("string").alias("value"))

    def parts(name: Column) -> Column:
        return F.split(name, r"\.", -1)

    def is_region(name: Column) -> Column:
        p = parts(name)
        return (F.size(p) == 3) & (p[0] == "region") & (p[1] != "") & p[2].isin(*limits) if limits else F.lit(False)

    def to_cells(entry: Column) -> Column:
        name, value = F.lower(entry["key"]), entry["value"].cast("double")
        out = F.when(name.isin(*routes.exposure), F.array(cell("exposure", "mode", F.lit('"auto"')), cell("exposure", "target_offset", value)))
        for slot, (stage, key) in slots.items():
            own = [cell(stage, key, value)] + ([cell(stage, "enabled", F.lit("true"))] if (stage, key) in routes.switched else [])
            out = out.when(name == slot, F.array(*own))
        return out.when(is_region(name), F.array(cell("region_adjust", "enabled", F.lit("true")))).otherwise(F.array().cast(f"array<{pair}>"))

    def nested(cells: Column) -> Column:
        stages = F.array_distinct(F.transform(cells, lambda c: c["stage"]))

        def keys_of(stage: Column) -> Column:
            # Of two names for one slot the last decides.
            own = F.filter(cells, lambda c: c["stage"] == stage)
            keys = F.array_distinct(F.transform(own, lambda c: c["key"]))
            return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(own, lambda c: c["key"] == k), -1)["value"]))

        return F.map_from_arrays(stages, F.transform(stages, keys_of))

    def regional(found: Column) -> Column:
        def held(entry: Column) -> Column:
            p = parts(F.lower(entry["key"]))
            limit = F.coalesce(*[F.when(p[2] == k, F.lit(float(v))) for k, v in limits.items()])
            return F.struct(p[1].alias("name"), p[2].alias("key"), F.greatest(-limit, F.least(limit, entry["value"].cast("double"))).alias("value"))

        def of(cells: Column) -> Column:
            names = F.array_distinct(F.transform(cells, lambda c: c["name"]))

            def keys_of(name: Column) -> Column:
                own = F.filter(cells, lambda c: c["name"] == name)
                keys = F.array_distinct(F.transform(own, lambda c: c["key"]))
                return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(own, lambda c: c["key"] == k), -1)["value"]))

            return F.map_from_arrays(names, F.transform(names, keys_of))

        return bound(F.transform(F.filter(found, lambda e: is_region(F.lower(e["key"]))), held), of)

    def known(name: Column) -> Column:
        return name.isin(*routes.exposure, *slots) | is_region(name)

    def whole(found: Column) -> Column:
        update = bound(F.flatten(F.transform(found, to_cells)), nested)
        regions = regional(found) if limits else F.create_map().cast("map<string,map<string,double>>")
        other = F.map_from_entries(F.transform(F.filter(found, lambda e: ~known(F.lower(e["key"]))), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value"))))
        base = F.coalesce(params, F.create_map().cast(NESTED))
        return F.struct(merge_deep(base, update).alias("params"), regions.alias("regions"), other.alias("other"))

    return bound(F.coalesce(entries, F.array().cast("array<struct<key:string,value:double>>")), whole)


def flattened(params: Column) -> Column:
    """A struct (exposure_ev, rest): the exposure as one number – a numeric mode itself, else the offset – and all stages but
    exposure and compose."""

    def number(key: str) -> Column:
        return F.try_element_at(F.try_element_at(params, F.lit("exposure")), F.lit(key)).try_cast("double")

    return F.struct(F.coalesce(number("mode"), number("target_offset")).alias("exposure_ev"), F.map_filter(params, lambda k, v: ~k.isin("exposure", "compose")).alias("rest"))


def target_value(targets: Column, metric: str | Column, fallback: Column | None = None) -> Column:
    """A metric's target from a map of JSON texts: a number, or an object's value, else its target; then the fallback."""
    text = F.try_element_at(targets, F.lit(metric) if isinstance(metric, str) else metric)
    found = F.coalesce(text.try_cast("double"), F.get_json_object(text, "$.value").try_cast("double"), F.get_json_object(text, "$.target").try_cast("double"))
    return found if fallback is None else F.coalesce(found, fallback)
