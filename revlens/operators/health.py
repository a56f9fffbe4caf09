"""Data-health and readiness tables.

Each loaded module is profiled by ONE wide aggregate (row count, non-null
count of every registered column, distinct id count); the rows of all
modules are then unioned. The module set is bounded (at most 15 registered
modules), so the union has at most 15 one-row branches; the work inside each
branch is a distributed aggregate over that module's table.

Join coverage per relationship is an existence join of the left keys against
the distinct right keys plus a duplicate check, all aggregates (see
``joins.coverage``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.operators import joins
from revlens.plans.semantic import NULL_WARNING_THRESHOLD
from revlens.sources.registry import DATE_COLUMNS, MODULES, PREFERRED_RELATIONSHIPS

PROFILE_SCHEMA = ("Module string, Column_Name string, Position int, Row_Count bigint, Null_Count bigint, "
                  "Null_Ratio double, Is_Id boolean, Duplicate_Count bigint, Is_Date boolean")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _pct0(ratio: Column) -> Column:
    """``{:.0%}`` text of a ratio."""
    return F.concat(F.format_number(ratio * F.lit(100.0), 0), F.lit("%"))


def profile_columns(name: str, df: DataFrame) -> list[str]:
    """Registered (required then optional) columns present, in registry order."""
    d = MODULES[name]
    return [c for c in (*d.required, *d.optional) if c in df.columns]


def module_profile(name: str, df: DataFrame) -> DataFrame:
    """D27 for one module: one row per profiled column (registered columns and
    date columns): nulls, null ratio, duplicate ids (non-null ids minus
    distinct ids), from a single aggregate."""
    d = MODULES[name]
    cols = profile_columns(name, df)
    for c in DATE_COLUMNS:
        if c in df.columns and c not in cols:
            cols.append(c)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(c)).alias(f"__nn{i}") for i, c in enumerate(cols)]
    has_id = d.id_column in df.columns
    if has_id:
        aggs.append(F.count_distinct(F.col(d.id_column)).alias("__distinct_id"))
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        nulls = F.col("__rows") - F.col(f"__nn{i}")
        is_id = has_id and c == d.id_column
        dup = (F.col(f"__nn{i}") - F.col("__distinct_id")) if is_id else F.lit(None).cast("bigint")
        rows.append(F.struct(
            F.lit(name).alias("Module"), F.lit(c).alias("Column_Name"), F.lit(i).alias("Position"),
            F.col("__rows").alias("Row_Count"), nulls.cast("bigint").alias("Null_Count"),
            F.try_divide(nulls.cast("double"), F.col("__rows").cast("double")).alias("Null_Ratio"),
            F.lit(is_id).alias("Is_Id"), dup.cast("bigint").alias("Duplicate_Count"),
            F.lit(c in DATE_COLUMNS).alias("Is_Date")))
    if not rows:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quality_profile(modules: dict[str, DataFrame]) -> DataFrame:
    """D27 over every registered module that is loaded."""
    frames = [module_profile(n, df) for n, df in modules.items() if n in MODULES]
    return _union(frames)


_HEALTH_EXPRS: dict[tuple, tuple[list[Column], list[Column]]] = {}


def _health_exprs(order: int, name: str, columns: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """(aggregates, output columns) of one module's health row. They depend only
    on the module, its position and its columns, so they are compiled once per
    JVM and layout."""
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), order, name, columns)
    if key in _HEALTH_EXPRS:
        return _HEALTH_EXPRS[key]
    d = MODULES[name]
    have = set(columns)
    missing = sorted(set(d.required) - have)
    reg = [c for c in (*d.required, *d.optional) if c in have]
    dates = [c for c in DATE_COLUMNS if c in have]
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(F.col(c)).alias(f"nn_{c}") for c in dict.fromkeys(reg + dates)]
    has_id = d.id_column in have
    if has_id:
        aggs.append(F.count_distinct(F.col(d.id_column)).alias("distinct_id"))
    rows = F.col("rows")
    items: list[Column] = []
    if has_id:
        dup = F.col(f"nn_{d.id_column}") - F.col("distinct_id")
        items.append(F.when(dup > 0, F.concat(F.lit(f"{name} has "), dup.cast("string"),
                                              F.lit(f" duplicate value(s) in {d.id_column}."))))
    for c in reg:
        ratio = F.try_divide((rows - F.col(f"nn_{c}")).cast("double"), rows.cast("double"))
        items.append(F.when(ratio >= F.lit(NULL_WARNING_THRESHOLD),
                            F.concat(F.lit(f"{name}.{c} is "), _pct0(ratio), F.lit(" empty."))))
    for c in dates:
        blanks = rows - F.col(f"nn_{c}")
        items.append(F.when(blanks > 0, F.concat(F.lit(f"{name}.{c} has "), blanks.cast("string"),
                                                 F.lit(" blank or unparseable date value(s)."))))
    quality = F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    warnings = F.when(rows == 0, F.array(F.lit(f"{name} has no rows."))).otherwise(quality)
    status = (F.when(F.lit(bool(missing)) | (rows == 0), F.lit("Warning"))
              .when(F.size(warnings) > 0, F.lit("Partial")).otherwise(F.lit("Healthy")))
    select = [F.lit(order).alias("Module_Order"), F.lit(name).alias("Module"), rows.alias("Rows"),
              F.lit(", ".join(d.required)).alias("Required_Columns"),
              F.lit("Complete" if not missing else f"Missing: {', '.join(missing)}").alias("Required_Status"),
              status.alias("Status"), warnings.alias("Warnings")]
    _HEALTH_EXPRS[key] = (aggs, select)
    return aggs, select


def module_health(modules: dict[str, DataFrame]) -> DataFrame:
    """Per module: rows, required / missing columns, status and warnings.

    Warnings, in order: no rows; duplicate ids; each registered column at
    least 60% empty; each date column with blanks. Status: Warning if a
    required column is missing or the module is empty, else Partial if any
    warning, else Healthy. One aggregate per module.
    """
    out = []
    for order, (name, df) in enumerate(modules.items()):
        if name not in MODULES:
            continue
        aggs, select = _health_exprs(order, name, tuple(df.columns))
        out.append(df.agg(*aggs).select(*select))
    return _union(out)


_REL_SCHEMA = ("Relationship_Order int, Left_Module string, Right_Module string, Join_Key string, Problem string, Problem_Status string")


def _relationship_columns() -> list[Column]:
    """Output columns of a relationship row over its coverage numbers (null: it cannot be checked)."""
    key, right, problem = F.col("Join_Key"), F.col("Right_Module"), F.col("Problem")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("left_rows", "right_rows", "rows_checked", "matched_rows")}
    dupl = F.coalesce(F.col("lookup_has_duplicates"), F.lit(False))
    empty_side = (n["left_rows"] == 0) | (n["right_rows"] == 0)
    available = ~empty_side & ~dupl
    reason = (F.when(empty_side, text("Join key `", key, "` exists but one module is empty."))
              .when(dupl, text("Join key `", key, "` has duplicates on the lookup side."))
              .otherwise(text("Join key `", key, "` is available.")))
    unmatched = n["rows_checked"] - n["matched_rows"]
    status = (F.when(dupl | (n["rows_checked"] == 0), F.lit("Warning")).when(unmatched > 0, F.lit("Partial")).otherwise(F.lit("Healthy")))
    details = (F.when(dupl, text("Lookup-side ", key, " has duplicates."))
               .when(n["rows_checked"] == 0, text("No non-empty ", key, " values are available to check."))
               .when(unmatched > 0, text(unmatched.cast("string"), " row(s) do not resolve to ", right, "."))
               .otherwise(text("All checked ", key, " values resolve to ", right, ".")))
    downgrade = (status == "Healthy") & ~available
    ok = problem.isNull()
    return [F.col("Left_Module"), right, key,
            (ok & available).alias("Available"), F.when(ok, reason).otherwise(problem).alias("Relationship_Reason"),
            F.when(ok, n["rows_checked"]).cast("bigint").alias("Rows_Checked"), F.when(ok, n["matched_rows"]).cast("bigint").alias("Matched"),
            F.when(ok, unmatched).cast("bigint").alias("Unmatched"),
            F.when(~ok, F.col("Problem_Status")).when(downgrade, F.lit("Warning")).otherwise(status).alias("Status"),
            F.when(~ok, problem).when(downgrade, reason).otherwise(details).alias("Details"), F.col("Relationship_Order")]


def join_health(spark: SparkSession, modules: dict[str, DataFrame]) -> DataFrame:
    """C10 + C11 + I2: one row per preferred relationship, in fixed order. A
    module that is the left side of several relationships is read once for them."""
    table, by_left = [], {}
    for i, (left, right, key) in enumerate(PREFERRED_RELATIONSHIPS):
        ldf, rdf = modules.get(left), modules.get(right)
        if ldf is None or rdf is None:
            table.append((i, left, right, key, "One or both modules are not loaded.", "Not available"))
        elif key not in ldf.columns or key not in rdf.columns:
            table.append((i, left, right, key, f"Missing join key `{key}` in one or both modules.", "Warning"))
        else:
            table.append((i, left, right, key, None, None))
            by_left.setdefault(left, []).append((i, rdf, key))
    # at most one row a preferred relationship, made of literals
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(
        r, (x.split() for x in _REL_SCHEMA.split(", ")))]) for r in table])).alias("r")).select("r.*")
    numbers = [joins.coverage(modules[left], lookups) for left, lookups in by_left.items()]
    if numbers:
        rows = rows.join(_union(numbers).withColumnRenamed("i", "Relationship_Order"), "Relationship_Order", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in ("left_rows", "right_rows", "rows_checked", "matched_rows")}
                                | {"lookup_has_duplicates": F.lit(None).cast("boolean")})
    return rows.select(*_relationship_columns()).withColumn("Relationship", F.concat_ws(" ↔ ", "Left_Module", "Right_Module"))


def relationships(spark: SparkSession, modules: dict[str, DataFrame]) -> DataFrame:
    """Relationship candidates with availability and reason."""
    return join_health(spark, modules).select("Relationship_Order", "Left_Module", "Right_Module", "Join_Key",
                                              "Available", F.col("Relationship_Reason").alias("Reason"))


def capabilities(spark: SparkSession, modules: dict[str, DataFrame],
                 rels: DataFrame | None = None) -> DataFrame:
    """The seven analytic capabilities, available flag and reason.

    Column presence is known on the driver; relationship availability comes
    from the (eight-row) relationships table, folded into one row.
    """
    rels = rels if rels is not None else relationships(spark, modules)
    flags = rels.agg(*[
        F.coalesce(F.max(F.when((F.col("Left_Module") == l) & (F.col("Right_Module") == r), F.col("Available"))),
                   F.lit(False)).alias(f"{l}|{r}")
        for (l, r) in (("Deals", "Leads"), ("Deals", "Accounts"), ("Deals", "Products"))])
    cols = {n: set(df.columns) for n, df in modules.items()}
    has = lambda m, *cs: m in modules and set(cs) <= cols[m]
    loaded = lambda m: m in modules
    rel = lambda l, r: F.col(f"`{l}|{r}`")
    lit = F.lit
    deals_loaded = loaded("Deals")
    caps = [
        ("Revenue", lit(has("Deals", "Amount")),
         "Available from Deals." if has("Deals", "Amount") else "Deals module with Amount is required."),
        ("Pipeline", lit(has("Deals", "Amount", "Forecast_Category")),
         "Forecast_Category is required in Deals." if deals_loaded else "Deals module missing."),
        ("Forecast", lit(has("Deals", "Forecast_Category")),
         "Forecast_Category missing from Deals." if deals_loaded else "Deals module missing."),
        ("Customer Analysis",
         lit(has("Deals", "Customer_Type"))
         | (lit(deals_loaded and has("Leads", "Customer_Type")) & rel("Deals", "Leads"))
         | (lit(deals_loaded and has("Accounts", "Account_Name")) & rel("Deals", "Accounts")),
         "Needs Customer_Type in Leads or an Accounts join." if deals_loaded else "Deals module missing."),
        ("Product Analysis",
         lit(has("Deals", "Product_Category")) | (lit(deals_loaded and loaded("Products")) & rel("Deals", "Products")),
         "Needs Product_Category in Deals or a valid Products join." if deals_loaded else "Deals module missing."),
        ("Regional Analysis",
         lit(has("Deals", "Region")) | (lit(has("Leads", "Region")) & rel("Deals", "Leads"))
         | lit(has("Accounts", "Region")),
         "Needs Region in Deals, Leads, or Accounts."
         if (deals_loaded or loaded("Leads") or loaded("Accounts")) else "No regional modules loaded."),
        ("Lead Conversion", lit(loaded("Leads") and deals_loaded) & rel("Deals", "Leads"),
         "Leads module missing." if not loaded("Leads") else "Lead_ID relationship between Deals and Leads is required."),
    ]
    structs = [F.struct(lit(i).alias("Capability_Order"), lit(n).alias("Capability"), a.alias("Available"),
                        F.when(a, lit("Enabled")).otherwise(lit("Disabled")).alias("Readiness"),
                        lit(reason).alias("Details"))
               for i, (n, a, reason) in enumerate(caps)]
    return flags.select(F.explode(F.array(*structs)).alias("c")).select("c.*")


def warning_list(module_rows: DataFrame, join_rows: DataFrame) -> DataFrame:
    """I4: ordered unique warnings: module warnings (module order, then warning
    order), then relationship warnings (status Partial or Warning) as
    ``Left ↔ Right: reason``; the first occurrence of a text keeps its place."""
    mw = module_rows.select(F.col("Module_Order").alias("g"),
                            F.posexplode("Warnings").alias("p", "Warning"))
    jw = (join_rows.where(F.col("Status").isin("Partial", "Warning"))
          .select((F.lit(1000) + F.col("Relationship_Order")).alias("g"), F.lit(0).alias("p"),
                  F.concat(F.col("Left_Module"), F.lit(" ↔ "), F.col("Right_Module"), F.lit(": "),
                           F.col("Details")).alias("Warning")))
    allw = mw.unionByName(jw).withColumn("o", F.col("g") * F.lit(100000) + F.col("p"))
    first = allw.groupBy("Warning").agg(F.min("o").alias("o"))
    return first.select("Warning", "o").orderBy("o").select(
        # bounded input (a few warnings per module): a single-partition window is fine
        F.row_number().over(Window.orderBy("o")).cast("bigint").alias("Position"),
        "Warning")


def health_summary(module_rows: DataFrame, caps: DataFrame, warnings: DataFrame) -> DataFrame:
    """I4 summary: module count, total rows, enabled capabilities, warnings."""
    m = module_rows.agg(F.count(F.lit(1)).alias("Module_Count"), F.sum("Rows").alias("Total_Rows"))
    c = caps.agg(F.count_if(F.col("Available")).alias("Enabled_Capabilities"))
    w = warnings.agg(F.count(F.lit(1)).alias("Warning_Count"))
    out = m
    for x in (c, w):
        out = out.withColumn("__k", F.lit(1)).join(F.broadcast(x.withColumn("__k", F.lit(1))), "__k").drop("__k")
    return out
