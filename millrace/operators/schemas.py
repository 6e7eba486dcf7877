"""Schema comparison: differences of two catalogs, their risk, and an ordered plan. Catalogs are rows (tbl, col, kind, nullable)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Risk and order of the kinds of change.
RISK = {"TableAdded": "Safe", "TableOnlyInCurrent": "Destructive", "ColumnAdded": "Warning", "ColumnOnlyInCurrent": "Destructive", "ColumnTypeChanged": "ManualReview", "ColumnNullableChanged": "Warning"}
ORDER = {"TableAdded": 10, "ColumnAdded": 40, "ColumnTypeChanged": 60, "ColumnNullableChanged": 70, "ColumnOnlyInCurrent": 200, "TableOnlyInCurrent": 280}


def catalog_rows(spark: SparkSession, schemas: dict[str, StructType]) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, s in schemas.items() for f in s.fields]
    return spark.createDataFrame(rows, "tbl string, col string, kind string, nullable boolean")


def difference(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """(change, tbl, col): tables on one side only, then columns of the tables on both."""
    wt, ct = wanted.select("tbl").distinct(), current.select("tbl").distinct()
    none = F.lit(None).cast("string").alias("col")
    tables = wt.join(ct, "tbl", "left_anti").select(F.lit("TableAdded").alias("change"), "tbl", none).unionByName(ct.join(wt, "tbl", "left_anti").select(F.lit("TableOnlyInCurrent").alias("change"), "tbl", none))
    both = wt.join(ct, "tbl", "left_semi")
    w, c = wanted.join(both, "tbl", "left_semi").alias("w"), current.join(both, "tbl", "left_semi").alias("c")
    pairs = w.join(c, (F.col("w.tbl") == F.col("c.tbl")) & (F.col("w.col") == F.col("c.col")), "full")
    change = (
        F.when(F.col("c.tbl").isNull(), "ColumnAdded").when(F.col("w.tbl").isNull(), "ColumnOnlyInCurrent")
        .when(F.col("w.kind") != F.col("c.kind"), "ColumnTypeChanged").when(F.col("w.nullable") != F.col("c.nullable"), "ColumnNullableChanged")
    )
    columns = pairs.select(change.alias("change"), F.coalesce("w.tbl", "c.tbl").alias("tbl"), F.coalesce("w.col", "c.col").alias("col")).filter("change is not null")
    return tables.unionByName(columns)


def plan(changes: DataFrame) -> DataFrame:
    """Changes with risk, decision and step number: creations first, removals last."""
    look = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("change")]
    risk = look(RISK)
    decision = F.when(risk == "Safe", "Allowed").when(risk == "Destructive", "RequiresConfirmation").when(risk == "ManualReview", "ManualReviewRequired").otherwise("Allowed")
    made = changes.withColumns({"risk": risk, "decision": decision, "at": look(ORDER)})
    # a schema's changes are few: one ordering over all of them
    return made.withColumn("step", F.row_number().over(Window.orderBy("at", "tbl", F.col("col").asc_nulls_first()))).drop("at")


# Risk of a change by object; of a changed column by property; place of a step in a plan by object or property.
OBJECT_RISK = {
    "table": {"Added": "Safe", "OnlyInCurrent": "Destructive", "Changed": "ManualReview"},
    "column": {"Added": "Warning", "OnlyInCurrent": "Destructive", "Changed": "Warning"},
    "primary_key": {"Added": "ManualReview", "OnlyInCurrent": "ManualReview", "Changed": "ManualReview"},
    "foreign_key": {"Added": "Warning", "OnlyInCurrent": "Destructive", "Changed": "ManualReview"},
    "index": {"Added": "Safe", "OnlyInCurrent": "Warning", "Changed": "Warning"},
    "view": {"Added": "Safe", "OnlyInCurrent": "Destructive", "Changed": "Warning"},
    "trigger": {"Added": "Warning", "OnlyInCurrent": "Destructive", "Changed": "ManualReview"},
    "sequence": {"Added": "Unsupported", "OnlyInCurrent": "Unsupported", "Changed": "Unsupported"},
}
PROPERTY_RISK = {"type": "ManualReview", "maxLength": "ManualReview", "precision": "ManualReview", "scale": "ManualReview", "defaultValue": "Safe", "unique": "Warning", "primaryKey": "ManualReview", "autoIncrement": "ManualReview"}
ADD_ORDER = {"table": 10, "column": 20, "primary_key": 30, "foreign_key": 40, "index": 50, "view": 60, "trigger": 70, "sequence": 80}
DROP_ORDER = {"foreign_key": 210, "index": 220, "primary_key": 230, "column": 240, "trigger": 250, "view": 260, "sequence": 270, "table": 280}
CHANGE_ORDER = {"defaultValue": 110, "nullable": 120, "type": 130, "view": 150, "trigger": 160}
LAST = 1000


@dataclass(frozen=True)
class ChangePolicy:
    """Which risks may run, and which of them only when confirmed."""

    safe: bool = True
    warnings: bool = True
    destructive: bool = False
    manual_review: bool = False
    unsupported: bool = False
    confirm_warnings: bool = False
    confirm_destructive: bool = True

    def decision(self, risk: Column) -> Column:
        warned = ("RequiresConfirmation" if self.confirm_warnings else "Allowed") if self.warnings else "Blocked"
        return (
            F.when(risk == "Safe", "Allowed" if self.safe else "Blocked").when(risk == "Warning", warned)
            .when(risk == "Destructive", "Allowed" if self.destructive and not self.confirm_destructive else "RequiresConfirmation")
            .when(risk == "ManualReview", "Allowed" if self.manual_review else "ManualReviewRequired")
            .otherwise("Allowed" if self.unsupported else "Unsupported")
        )


def looked_up(m: dict, key: Column, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), key), F.lit(other))


def object_changes(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """(object, tbl, name, change, property, current, wanted) from catalogs of (object, tbl, name, properties map<string,string>).

    An object on one side only is one change; one on both is a change for each property that differs (absent: null). Columns,
    primary keys and triggers of a table that is itself added or left go with it; its indexes and foreign keys are steps of
    their own. name is not null (empty for tables, views and sequences).
    """
    keys = ["object", "tbl", "name"]
    pairs = wanted.withColumnRenamed("properties", "w").join(current.withColumnRenamed("properties", "c"), keys, "full")
    change = F.when(F.col("c").isNull(), "Added").when(F.col("w").isNull(), "OnlyInCurrent").otherwise("Changed")
    differing = F.filter(F.array_distinct(F.concat(F.map_keys("w"), F.map_keys("c"))), lambda k: ~F.try_element_at("w", k).eqNullSafe(F.try_element_at("c", k)))
    names = F.when(change == "Changed", differing).otherwise(F.array(F.lit(None).cast("string")))
    value = lambda m: F.when(F.col("property").isNotNull(), F.try_element_at(m, F.col("property"))).alias({"c": "current", "w": "wanted"}[m])
    found = pairs.select(*keys, change.alias("change"), "w", "c", F.explode(names).alias("property")).select(*keys, "change", "property", value("c"), value("w"))
    whole = found.filter("object = 'table' and property is null").select("tbl", "change")
    goes_along = F.col("object").isin("column", "primary_key", "trigger") & F.col("property").isNull()
    own = found.filter(goes_along).join(whole, ["tbl", "change"], "left_anti").select(*found.columns)
    return own.unionByName(found.filter(~goes_along))


def object_plan(changes: DataFrame, policy: ChangePolicy = ChangePolicy()) -> DataFrame:
    """Changes with risk, the policy's decision and step: additions, then alterations, then removals."""
    by_object = F.lit("Unsupported")
    for name, risks in OBJECT_RISK.items():
        by_object = F.when(F.col("object") == name, looked_up(risks, F.col("change"), "Unsupported")).otherwise(by_object)
    nullable = F.when(F.col("wanted") == "true", "Warning").otherwise("ManualReview")
    by_property = F.when(F.col("property") == "nullable", nullable).otherwise(looked_up(PROPERTY_RISK, F.col("property"), "Warning"))
    risk = F.when((F.col("object") == "column") & (F.col("change") == "Changed"), by_property).otherwise(by_object)
    kind = F.when(F.col("object") == "column", F.col("property")).otherwise(F.col("object"))
    altered = looked_up(CHANGE_ORDER, kind, LAST)
    at = F.when(F.col("change") == "Added", looked_up(ADD_ORDER, F.col("object"), LAST)).when(F.col("change") == "OnlyInCurrent", looked_up(DROP_ORDER, F.col("object"), LAST)).otherwise(altered)
    made = changes.withColumn("risk", risk).withColumns({"decision": policy.decision(F.col("risk")), "at": at})
    # a schema's changes are few: one ordering over all of them
    return made.withColumn("step", F.row_number().over(Window.orderBy("at", "tbl", "name", F.col("property").asc_nulls_first()))).drop("at")


# Names of types and the one they are compared by.
TYPE_NAMES = {
    "INT": "INTEGER", "INT4": "INTEGER", "SIGNED INTEGER": "INTEGER", "UNSIGNED INTEGER": "INTEGER", "INT8": "BIGINT", "INT2": "SMALLINT", "BOOL": "BOOLEAN", "CHARACTER VARYING": "VARCHAR", "STRING": "VARCHAR",
    "DOUBLE PRECISION": "DOUBLE", "FLOAT8": "DOUBLE", "REAL": "FLOAT", "NUMERIC": "DECIMAL", "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP", "DATETIME": "TIMESTAMP",
}
KEYWORDS = ("onDelete", "onUpdate")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def type_name(c: Column) -> Column:
    """Upper case, single spaces, the usual name; what stands in parentheses stays."""
    up = F.upper(squeezed(c))
    base, rest = F.regexp_extract(up, r"^([^(]*?)\s*(?:\(.*\))?$", 1), F.regexp_extract(up, r"(\(.*\))$", 1)
    return F.concat(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TYPE_NAMES.items() for x in kv)), base), base), rest)


def default_value(c: Column) -> Column:
    """Without one outer pair of parentheses; null and NULL are empty; times in upper case, booleans in lower."""
    bare = squeezed(F.regexp_replace(squeezed(F.coalesce(c, F.lit(""))), r"^\((.*)\)$", "$1"))
    up = F.upper(bare)
    return F.when(up == "NULL", "").when(up.isin("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME"), up).when(up.isin("TRUE", "FALSE"), F.lower(bare)).otherwise(bare)


def normalised(objects: DataFrame) -> DataFrame:
    """A catalog of (object, tbl, name, properties) in the form in which catalogs are compared, and in order: names trimmed, types by their
    usual name, defaults and keywords as default_value and upper case with _ say, other values with single spaces."""
    value = lambda k, v: F.when(k == "type", type_name(v)).when(k == "defaultValue", default_value(v)).when(k.isin(*KEYWORDS), F.regexp_replace(F.upper(squeezed(v)), " ", "_")).otherwise(squeezed(v))
    clean = objects.select("object", squeezed(F.col("tbl")).alias("tbl"), squeezed(F.col("name")).alias("name"), F.transform_values("properties", value).alias("properties"))
    return clean.orderBy("object", "tbl", "name")


HISTORY = "id string, at timestamp, plan_id string, applied_by string, success boolean, dry_run boolean, message string, steps array<struct<step:int,change:string,tbl:string,name:string,risk:string>>"


def append_history(record: DataFrame, path: str) -> None:
    """One record of an applied plan (HISTORY without id) as a line of JSON more; its id is a hash of plan and time."""
    made = record.withColumn("id", F.concat(F.lit("schema_history_"), F.lower(F.hex(F.xxhash64("plan_id", "at")))))
    made.select(*(x.split(" ")[0] for x in ("id", "at", "plan_id", "applied_by", "success", "dry_run", "message", "steps"))).coalesce(1).write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All records, the oldest first."""
    return spark.read.schema(HISTORY).json(path).orderBy("at", "id")
