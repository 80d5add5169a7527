"""Validation, artifacts and public views of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lexspark.functions import text as T
from lexspark.operators import nested

SEVERITY = ("critical", "major", "minor", "info")
STATUS = ("pass", "fail", "warn", "insufficient_context", "info")


def _fits(value: Column, kind: DataType, path: str) -> Column:
    """An array of paths below ``value`` (a variant) that can't be read as ``kind``; numbers in texts and the like are coerced."""
    if isinstance(kind, ArrayType):
        inner = value.try_cast("array<variant>")
        if isinstance(kind.elementType, (ArrayType, StructType, MapType)):
            deeper = F.flatten(F.transform(inner, lambda v, i: F.transform(_fits(v, kind.elementType, ""), lambda p: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]"), _below(p)))))
        else:
            bad = F.filter(F.transform(inner, lambda v, i: F.when(_wrong(v, kind.elementType), i)), lambda i: i.isNotNull())
            deeper = F.transform(bad, lambda i: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")))
        return F.when(_absent(value), _none()).when(inner.isNull(), F.array(F.lit(path))).otherwise(F.coalesce(deeper, _none()))
    if isinstance(kind, MapType):
        inner = value.try_cast("map<string,variant>")
        bad = F.map_keys(F.map_filter(inner, lambda k, v: _wrong(v, kind.valueType)))
        return F.when(_absent(value), _none()).when(inner.isNull(), F.array(F.lit(path))).otherwise(F.transform(F.array_sort(bad), lambda k: F.concat(F.lit(f"{path}."), k)))
    if isinstance(kind, StructType):
        inner = value.try_cast("map<string,variant>")
        parts = [_fits(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType, f"{path}.{f.name}" if path else f.name) for f in kind.fields]
        held = F.concat(*parts) if parts else _none()
        return F.when(_absent(value), _none()).when(inner.isNull(), F.array(F.lit(path or "$"))).otherwise(held)
    return F.when(_wrong(value, kind), F.array(F.lit(path))).otherwise(_none())


def _below(path: Column) -> Column:
    """A path inside an array's place, as it goes on behind the bracket."""
    return F.when(path.isin("", "$"), "").when(path.startswith("[") | path.startswith("."), path).otherwise(F.concat(F.lit("."), path))


def _none() -> Column:
    return F.array().cast("array<string>")


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _wrong(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (ArrayType, StructType, MapType)):
        return F.size(_fits(value, kind, "")) > 0
    return ~_absent(value) & (nested.kind_of(value).isin("object", "array") | value.try_cast(kind.simpleString()).isNull())


def validate(rows: DataFrame, schema: str, json_col: str = "json") -> DataFrame:
    """``record`` read by the schema and ``error``: null, ``no object``, or the paths that can't be read as their type.

    ``schema`` is DDL or a ``struct<…>``, with types of any depth.  Values are coerced where a cast can (a number in a text, a text of a number);
    an absent or null value fits any type; fields that the schema lacks are dropped.  Paths name array places (``b[2]``) and map keys (``m.k``).
    """
    kind = StructType.fromDDL(schema)
    if schema.strip().lower().startswith("struct<") and len(kind.fields) == 1 and isinstance(kind.fields[0].dataType, StructType):
        kind = kind.fields[0].dataType
    value = F.try_parse_json(F.col(json_col))
    held = rows.withColumn("_v", value).withColumn("_bad", _fits(F.col("_v"), kind, ""))
    is_object = F.col("_v").try_cast("map<string,variant>").isNotNull()
    record = F.struct(*[_read(F.try_variant_get("_v", f"$['{f.name}']", "variant"), f.dataType).alias(f.name) for f in kind.fields])
    error = F.when(~F.coalesce(is_object, F.lit(False)), "no object").when(F.size("_bad") > 0, F.concat(F.lit("bad fields: "), F.array_join("_bad", ", ")))
    return held.withColumn("record", F.when(is_object, record)).withColumn("error", error).drop("_v", "_bad")


def _read(value: Column, kind: DataType) -> Column:
    """``value`` as ``kind``; parts that can't be read are null and the rest stays."""
    if isinstance(kind, ArrayType):
        return F.transform(value.try_cast("array<variant>"), lambda v: _read(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(value.try_cast("map<string,variant>"), lambda k, v: _read(v, kind.valueType))
    if isinstance(kind, StructType):
        fields = F.struct(*[_read(F.try_variant_get(value, f"$['{f.name}']", "variant"), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.try_cast("map<string,variant>").isNotNull(), fields)
    return F.when(~_absent(value) & ~nested.kind_of(value).isin("object", "array"), value.try_cast(kind.simpleString()))


def validate_issues(issues: DataFrame) -> DataFrame:
    """``errors`` of each issue: enumerations, confidence between 0 and 1, path prefix."""
    tests = [(~F.col("severity").isin(*SEVERITY) | F.col("severity").isNull(), "severity"), (~F.col("status").isin(*STATUS) | F.col("status").isNull(), "status"), (F.col("confidence").isNull() | F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence"), (~F.coalesce("path", F.lit("")).startswith("/"), "path")]
    return issues.withColumn("errors", F.array_compact(F.array(*[F.when(t, n) for t, n in tests])))


def metadata_summary(records: DataFrame) -> DataFrame:
    return records.select("doc_id", "标准号", "标准中文名称", "标准层级", "标准性质", "制修订", "ics")


def public_artifacts(rows: DataFrame, expose_path: bool = False) -> DataFrame:
    return rows if expose_path else rows.drop("host_path")


def artifacts_for(rows: DataFrame, thread: str, artifact: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Artifacts of one thread, or one of them; with ``files`` (path) only those that exist."""
    out = rows.where(F.col("thread_id") == thread)
    out = out if artifact is None else out.where(F.col("artifact_id") == artifact)
    return out if files is None else out.join(files, out["virtual_path"] == files["path"], "left_semi")


def artifact_map(rows: DataFrame) -> DataFrame:
    """(doc_id, artifacts): the last artifact of each type."""
    last = rows.groupBy("doc_id", "type").agg(F.max_by("artifact_id", "ord").alias("a"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "a")))).alias("artifacts"))


def artifacts_of(results: DataFrame, spec: DataFrame) -> DataFrame:
    """(id, type, virtual_path): artifacts named in results by the dotted paths that ``spec`` (tool, field, type) lists for the tool."""
    met = results.join(spec, "tool")
    path = F.expr("get_json_object(result, concat('$.', field))")
    return met.select("id", "type", path.alias("virtual_path")).where("coalesce(virtual_path, '') <> ''")


def dotted(json: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text, empty if there is none."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(""))


def download_url(thread: Column, artifact: Column, base: str = "") -> Column:
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{base}/threads/"), part(thread), F.lit("/artifacts/"), part(artifact))


def review_response(issues: DataFrame, artifacts: DataFrame, with_report: bool = False) -> DataFrame:
    """(doc_id, status, passed, artifacts): the public answer to a review; with its report, a row a page (page, report)."""
    from lexspark.operators import review

    out = review.verdict(issues).withColumn("status", F.lit("success")).join(artifact_map(artifacts), "doc_id", "left")
    return out.join(review.render_report(issues), "doc_id", "left") if with_report else out


def prepend_cover(text: Column, fields: dict[str, Column]) -> Column:
    """Text with a block of the filled cover fields in front."""
    lines = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}："), v)) for k, v in fields.items()]))
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), text)).otherwise(text)


def base_name(number: Column, stem: Column) -> Column:
    bare = F.replace(F.replace(F.coalesce(number, F.lit("")), F.lit("/"), F.lit("-")), F.lit(" "), F.lit("-"))
    return F.when(F.coalesce(number, F.lit("")) != "", T.safe_name(bare)).otherwise(T.safe_name(stem))


def pick(items: Column, wanted: Column) -> Column:
    """The item with the wanted id, else the first."""
    return F.coalesce(F.get(F.filter(items, lambda x: x["id"] == wanted), 0), F.get(items, 0))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def location_text(location: Column, style: Column) -> Column:
    return F.format_string("位置=%s，样式=%s", F.coalesce(location, F.lit("")), first_filled(style, F.lit("未命名样式")))
