"""Search and drill-down over log rows."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidelog.functions.fixed import GATEWAY_SERVICE
from tidelog.functions.text import level_predicate, severity_is, text_match
from tidelog.functions.values import at, before, micros, time_bounded
from tidelog.operators.bounded import small_side
from tidelog.operators.ordered import slot_of
from tidelog.operators.scope import first_rows, service_name
from tidelog.session import cut_lineage


def not_gateway(df: DataFrame) -> DataFrame:
    """Rows of other services than the gateway; a row without a service is none of the gateway's."""
    return df.filter(F.coalesce(F.col("ServiceName"), F.lit("")) != GATEWAY_SERVICE)


def search(df: DataFrame, as_of: str | Column, host: str = "", project: str = "", service: str = "",
           containers: Sequence[str] = (), level: str = "", text: str = "",
           from_ts: str | None = None, to_ts: str | None = None, hours: float = 24) -> DataFrame:
    """Rows that meet all given conditions; the last `hours` where no time is given."""
    rows = not_gateway(df)
    if host:
        rows = rows.filter(F.col("HostName") == host)
    if project:
        rows = rows.filter(F.col("ComposeProject") == project)
    if service:
        rows = rows.filter(service_name(df) == service)
    if containers:
        rows = rows.filter(F.col("ContainerName").isin(*containers))
    if level:
        rows = rows.filter(level_predicate(level))
    if text:
        rows = rows.filter(text_match("Body", text) | text_match("ContainerName", text))
    if from_ts or to_ts:
        return time_bounded(rows, from_ts, to_ts)
    return time_bounded(rows, before(as_of, hours, "HOUR"), open_start=True)


def page(df: DataFrame, number: int, size: int, descending: bool = True,
         ts: str = "Timestamp", tie: Sequence[str] = ("LogId",)) -> DataFrame:
    """Page `number` (from 0) in time order; the tie-break columns make pages disjoint."""
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    return df.orderBy(*[direction(c) for c in (ts, *tie)]).offset(number * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint").alias("pages"))


def context(df: DataFrame, container: str, ts: str | Column, seconds: int = 30, cap: int = 2000) -> DataFrame:
    """Rows of one container around a time, ascending."""
    if not 1 <= seconds <= 300:
        raise ValueError("seconds must lie in 1..300")
    rows = df.filter(F.col("ContainerName") == container)
    rows = time_bounded(rows, before(ts, seconds), before(ts, -seconds))
    return rows.orderBy("Timestamp", "LogId").limit(cap)


def around(df: DataFrame, anchors: DataFrame, seconds: int = 30, keys: Sequence[str] = ("ContainerName",),
           ts: str = "Timestamp", anchor_ts: str = "anchor_ts") -> DataFrame:
    """Rows within +/- `seconds` of each anchor of the same key, for many anchors at once.

    An equi-join on key and time slot: every anchor is listed under the slots its window
    touches (at most three), so a busy container is spread over its slots. Few anchors are
    broadcast, and the rows stay where they are.
    """
    width = 2 * seconds * 1_000_000
    reach = seconds * 1_000_000
    keys = list(keys)
    spread = (anchors.withColumn("_anchor_us", micros(anchor_ts))
              .withColumn("_slot", F.explode(F.sequence(
                  slot_of(F.col("_anchor_us") - reach, width), slot_of(F.col("_anchor_us") + reach, width)))))
    rows = df.withColumn("_us", micros(ts)).withColumn("_slot", slot_of(F.col("_us"), width))
    distance = F.col("_us") - F.col("_anchor_us")
    return (rows.join(small_side(spread), [*keys, "_slot"])
            .filter(F.abs(distance) <= reach)
            .withColumn("delta_us", distance)
            .drop("_slot", "_us", "_anchor_us"))


def context_bulk(df: DataFrame, anchors: DataFrame, seconds: int = 30, cap: int = 2000) -> DataFrame:
    """`context` for a table of (ContainerName, anchor_ts), up to `cap` rows per anchor.

    The log is cut down to the slots that the anchors' windows touch before anything else: where these are few, they are
    broadcast and no other row moves. Rows are numbered per container and time slot. An anchor knows how many rows of its first slot lie before its window, so
    it meets only the next `cap` of them, and the first `cap` of the following slots: at most three times what is kept,
    however dense the rows are.
    """
    key, reach = "ContainerName", seconds * 1_000_000
    width = 2 * reach
    by_time = Window.partitionBy(key, "_slot").orderBy("_us", "LogId")
    starts = cut_lineage(anchors.select(key, "anchor_ts").distinct().withColumn("_anchor_us", micros("anchor_ts"))
                         .withColumn("_us", F.col("_anchor_us") - reach).withColumn("_slot", slot_of(F.col("_us"), width)))
    touched = small_side(starts.select(key, F.explode(F.sequence(F.col("_slot"), slot_of(F.col("_anchor_us") + reach, width))).alias("_slot")).distinct())
    near = df.withColumn("_us", micros("Timestamp")).withColumn("_slot", slot_of(F.col("_us"), width)).join(touched, [key, "_slot"], "left_semi")
    rows = near.withColumn("_rank", F.row_number().over(by_time) - 1).withColumn("_block", F.floor(F.col("_rank") / cap))
    # How many rows of the slot lie before the window: both are merged in time order, never paired.
    merged = (near.select(key, "_us", F.lit(1).alias("_row"), "_slot")
              .join(starts.select(key, "_slot").distinct(), [key, "_slot"], "left_semi")
              .unionByName(starts.withColumn("_row", F.lit(0)), allowMissingColumns=True))
    passed = Window.partitionBy(key, "_slot").orderBy("_us", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (merged.withColumn("_skip", F.sum("_row").over(passed)).filter(F.col("_row") == 0)
              .select(key, "anchor_ts", "_anchor_us", F.col("_slot").alias("_first"), "_skip"))
    slots = F.sequence(F.col("_first"), slot_of(F.col("_anchor_us") + reach, width))
    skipped = F.when(F.col("_slot") == F.col("_first"), F.col("_skip")).otherwise(0)
    spread = (placed.withColumn("_slot", F.explode(slots)).withColumn("_from", skipped)
              .withColumn("_block", F.explode(F.array_distinct(F.array(F.floor(F.col("_from") / cap), F.floor((F.col("_from") + cap - 1) / cap)))))
              .drop("_first", "_skip"))
    distance = F.col("_us") - F.col("_anchor_us")
    met = (rows.join(spread, [key, "_slot", "_block"])
           .filter((F.abs(distance) <= reach) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + cap))
           .withColumn("delta_us", distance).drop("_slot", "_us", "_anchor_us", "_rank", "_block", "_from"))
    return first_rows(met, [key, "anchor_ts"], [F.col("Timestamp"), F.col("LogId")], cap)


def context_summary(rows: DataFrame, anchor: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, errors and warnings of a context and its anchor row: the nearest in time, the first of equals."""
    distance = F.abs(micros("Timestamp") - micros(at(anchor)))
    nearest = F.min(F.struct(distance.alias("d"), F.col("Timestamp").alias("t"), F.col("LogId").alias("i")))
    return (rows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(severity_is("error")).alias("errors"),
                 F.count_if(severity_is("warn", "warning")).alias("warnings"),
                 nearest.alias("_n"))
            .select(*keys, "rows", "errors", "warnings", F.col("_n.i").alias("anchor_id"),
                    F.col("_n.t").alias("anchor_row_ts"), F.col("_n.d").alias("distance_us")))


def with_distance(rows: DataFrame, anchor: str | Column) -> DataFrame:
    """Rows of one context (bounded by its cap) with signed distance and the anchor mark."""
    distance = micros("Timestamp") - micros(at(anchor))
    nearest = Window.partitionBy(F.lit(1)).orderBy(F.abs("delta_us"), "Timestamp", "LogId")
    return (rows.withColumn("delta_us", distance)
            .withColumn("is_anchor", F.row_number().over(nearest) == 1))


def trace(df: DataFrame, trace_id: str, cap: int = 500) -> DataFrame:
    """Rows of a trace, ascending. Pass a scoped table for users with a scope."""
    return (df.filter(F.col("TraceId") == trace_id).orderBy("Timestamp", "LogId").limit(cap)
            .select("Timestamp", "ServiceName", "SeverityText", "Body", "ContainerName"))


def trace_summary(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("TraceId") != "").groupBy("TraceId")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(severity_is("error")).alias("errors"),
                 F.count_if(severity_is("warn", "warning")).alias("warnings")))


def sample_logs(df: DataFrame, from_ts: str, to_ts: str, level: str = "", n: int = 5) -> DataFrame:
    """Latest rows of a half-open time range and level."""
    rows = time_bounded(not_gateway(df), from_ts, to_ts, open_end=True)
    if level:
        rows = rows.filter(severity_is(level.lower()))
    return (rows.orderBy(F.col("Timestamp").desc(), F.col("LogId").desc()).limit(n)
            .select("Timestamp", "ServiceName", "ContainerName", "SeverityText", "Body"))


_READING = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "LateralJoin", "Union",
            "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition",
            "OneRowRelation", "UnresolvedSubqueryColumnAliases", "Generate", "Pivot", "Unpivot", "UnresolvedInlineTable",
            "LocalRelation", "UnresolvedHint", "Tail", "Sample"}
_EXPRESSIONS = {
    "Add", "AggregateExpression", "Alias", "And", "AnyValue", "AttributeReference", "BitwiseAnd", "BitwiseNot", "BitwiseOr", "BitwiseXor",
    "CaseWhen", "Cast", "Collate", "Concat", "CreateNamedStruct", "Cube", "CurrentRow", "Divide", "EqualNullSafe", "EqualTo", "Exists", "First",
    "GreaterThan", "GreaterThanOrEqual", "GroupingSets", "ILike", "In", "InSubquery", "IntegralDivide", "IsNotNull", "IsNull", "LambdaFunction",
    "Last", "LateralSubquery", "LessThan", "LessThanOrEqual", "Like", "LikeAll", "LikeAny", "ListQuery", "Literal", "MultiAlias", "Multiply",
    "NamedArgumentExpression", "Not", "NotLikeAll", "NotLikeAny", "Or", "Overlay", "RLike", "Remainder", "Rollup", "ScalarSubquery",
    "SemiStructuredExtract", "ShiftLeft", "ShiftRight", "ShiftRightUnsigned", "SortOrder", "SpecifiedWindowFrame", "StringLocate", "StringTrim",
    "StringTrimLeft", "StringTrimRight", "Substring", "Subtract", "TimestampAdd", "TimestampDiff", "UnaryMinus", "UnaryPositive", "UnboundedFollowing",
    "UnboundedPreceding", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedCollation", "UnresolvedExtractValue", "UnresolvedFunction",
    "UnresolvedGenerator", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "UnresolvedStar", "UnresolvedStarExceptOrReplace",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWindowExpression", "UnspecifiedFrame", "WindowExpression", "WindowSpecDefinition"}
_LEAVING = {"reflect", "java_method", "try_reflect", "current_catalog", "current_database", "current_schema", "current_user", "user",
            "session_user", "input_file_name", "input_file_block_start", "input_file_block_length", "from_protobuf", "to_protobuf", "version"}
_LEAVING_CLASSES = {"CallMethodViaReflection", "TryReflect", "CurrentCatalog", "CurrentDatabase", "CurrentUser", "InputFileName", "InputFileBlockStart",
                    "InputFileBlockLength", "FromProtobuf", "ToProtobuf", "SparkVersion", "ScalaUDF", "PythonUDF", "PythonUDAF", "HiveSimpleUDF",
                    "HiveGenericUDF", "HiveUDAFFunction"}
_analysis = threading.Lock()


def query(spark: SparkSession, sql: str, scoped_df: DataFrame, view: str = "logs") -> DataFrame:
    """Read-only SQL over the caller's rows, which the statement knows as `view`.

    The parsed statement must be a query that reads that view and its own WITH names alone: files, other tables, commands, table
    functions and names made up at run time are refused, as is every kind of plan or expression that isn't known to read. What
    names stand for is known after the analysis only, so it is looked at again before anything runs: calls into the JVM, user-defined
    functions and functions that tell of the session, its user or the files are refused. The name exists
    only while the statement is analysed, for one caller at a time.
    """
    statement = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    _check_reading(statement, {view.lower()})
    with _analysis:
        scoped_df.createOrReplaceTempView(view)
        try:
            found = spark.sql(sql)
        finally:
            spark.catalog.dropTempView(view)
    _check_analysed(found._jdf.queryExecution().analyzed())
    return found


def _scala(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check_reading(plan, names: set[str]) -> None:
    """Raises unless every node of the parsed plan reads, and reads known names."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in _READING:
        raise ValueError(f"only queries of the given rows are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        parts = _scala(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in names:
            raise ValueError(f"unknown relation {'.'.join(parts)}")
    if kind == "UnresolvedWith":
        for relation in _scala(plan.cteRelations()):
            _check_reading(relation._2(), names)
            names = names | {relation._1().lower()}
    for child in _scala(plan.children()):
        _check_reading(child, names)
    for expression in _scala(plan.expressions()):
        _check_expression(expression, names)


def _check_expression(expression, names: set[str]) -> None:
    kind = expression.getClass().getSimpleName().rstrip("$")
    if kind not in _EXPRESSIONS:
        raise ValueError(f"{kind} is not allowed")
    if kind == "UnresolvedFunction" and _scala(expression.nameParts())[-1].lower() in _LEAVING:
        raise ValueError("this function is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_reading(expression.plan(), names)
    for child in _scala(expression.children()):
        _check_expression(child, names)


def _check_analysed(plan) -> None:
    """Raises if something in an analysed plan, above the given rows, leaves them."""
    if plan.getClass().getSimpleName() == "View":  # the given rows: what they are made of is the caller's
        return
    for child in _scala(plan.children()):
        _check_analysed(child)
    for expression in _scala(plan.expressions()):
        _check_resolved(expression)


def _check_resolved(expression) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in _LEAVING_CLASSES:
        raise ValueError("this function is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        _check_analysed(expression.plan())
    for child in _scala(expression.children()):
        _check_resolved(child)
