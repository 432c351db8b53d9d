"""Optimisation formulations from graph rows: constraints, bounds, variables, objectives, parameters, series, views.

Constraint rows carry entity, ord (their order within the entity) and the texts of the edge and its target:
relation, relation_id, name, variable, indicator, operator, value, unit, source_doc, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions import rules

PARAMETER_KEYS = ["dead_storage_level", "normal_storage_level", "flood_control_level", "total_capacity", "flood_control_capacity"]
#: Labels of the comparison view.
COMPARE_LABELS = {"dead_storage_level": "死水位", "normal_storage_level": "正常蓄水位", "flood_control_level": "防洪限制水位", "total_capacity": "总库容", "flood_control_capacity": "防洪库容"}


def categorise(text: Column) -> Column:
    return rules.first_word(text, fixed.CATEGORY_WORDS)


def category_by_id(relation_id: Column) -> Column:
    chain: Column | None = None
    for category, ids in fixed.CONSTRAINT_IDS.items():
        chain = F.when(relation_id.isin(ids), F.lit(category)) if chain is None else chain.when(relation_id.isin(ids), F.lit(category))
    return chain


def extract_operator(text: Column, published: bool = False) -> Column:
    """<=, >=, == or between, by ordered patterns; null without one.

    By default the negated forms are read as meant (不低于 is a lower bound); ``published`` keeps the published order.
    """
    chain: Column | None = None
    for pattern, sign in fixed.OPERATORS_PUBLISHED if published else fixed.OPERATORS_MEANT:
        chain = F.when(text.rlike(pattern), F.lit(sign)) if chain is None else chain.when(text.rlike(pattern), F.lit(sign))
    return chain


def extract_numeric(text: Column) -> Column:
    """struct(value, unit) of the first number and its unit; null without a number."""
    value = F.regexp_extract(text, fixed.VALUE_WITH_UNIT, 1)
    unit = F.nullif(F.regexp_extract(text, fixed.VALUE_WITH_UNIT, 2), F.lit(""))
    return F.when(value != "", F.struct(value.cast("double").alias("value"), unit.alias("unit")))


def _some(*columns: Column) -> Column:
    """The first non-empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def format_constraints(rows: DataFrame, published: bool = False) -> DataFrame:
    """Constraint records: id, name, expression, category, variable, operator, value, unit and provenance."""
    variable = F.coalesce(_some(F.col("variable"), F.col("indicator"), F.col("relation")), F.lit(""))
    operator = F.coalesce(_some(F.col("operator"), extract_operator(F.col("relation"), published), extract_operator(variable, published)), F.lit("unknown"))
    parsed = F.coalesce(extract_numeric(_some(F.col("value"))), extract_numeric(variable))
    by_text = F.coalesce(categorise(F.col("relation")), categorise(variable), categorise(F.col("indicator")), F.lit("unknown"))
    category = by_text if published else F.coalesce(by_text, category_by_id(F.col("relation_id")))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("ord"))
    out = rows.withColumns({"variable_": variable, "operator_": operator, "parsed": parsed, "category": category, "place": place})
    number = F.col("parsed.value")
    unit = F.coalesce(_some(F.col("unit"), F.col("parsed.unit")), F.lit(""))
    with_value = F.concat_ws(" ", "variable_", "operator_", number.cast("string"), F.nullif(unit, F.lit("")))
    expression = F.when(number.isNotNull(), with_value).otherwise(F.concat(F.col("variable_"), F.lit(" (operator: "), F.col("operator_"), F.lit(")")))
    return out.select(
        "entity",
        F.format_string("c_%03d", "place").alias("id"),
        F.coalesce(_some(F.col("name"), F.col("relation"), F.col("indicator"), F.col("variable_")), F.lit("")).alias("name"),
        expression.alias("expression"),
        "category",
        F.col("variable_").alias("variable"),
        F.col("operator_").alias("operator"),
        number.alias("value"),
        unit.alias("unit"),
        F.coalesce("source_doc", F.lit("")).alias("source_doc"),
        F.col("relation").alias("source_relation"),
        "confidence",
        F.col("place").alias("ord"),
    )


def bounds(constraints: DataFrame) -> DataFrame:
    """entity, category, lower, upper: an ordered fold, as an equality sets both bounds to its value."""
    steps = F.array_sort(F.collect_list(F.struct("ord", "operator", "value")))
    rows = constraints.where("value is not null").groupBy("entity", "category").agg(steps.alias("steps"))
    none = F.lit(None).cast("double")

    def fold(s: Column, c: Column) -> Column:
        v = c["value"]
        low = F.when(c["operator"] == ">=", F.coalesce(F.greatest(s["lower"], v), v)).when(c["operator"] == "==", v).otherwise(s["lower"])
        high = F.when(c["operator"] == "<=", F.coalesce(F.least(s["upper"], v), v)).when(c["operator"] == "==", v).otherwise(s["upper"])
        return F.struct(low.alias("lower"), high.alias("upper"))

    folded = F.aggregate("steps", F.struct(none.alias("lower"), none.alias("upper")), fold)
    return rows.select("entity", "category", folded.alias("b")).select("entity", "category", "b.*")


def format_parameters(parameters: DataFrame) -> DataFrame:
    """entity and five structs (value, unit); text values are read as numbers with a unit."""
    parsed = extract_numeric(F.col("value"))
    rows = parameters.withColumns({"number": parsed["value"], "text_unit": parsed["unit"]})
    one = F.struct(F.col("number").alias("value"), F.coalesce(_some(F.col("unit"), F.col("text_unit")), F.lit("")).alias("unit"))
    empty = F.struct(F.lit(None).cast("double").alias("value"), F.lit("").alias("unit"))
    return rows.groupBy("entity").agg(*[F.coalesce(F.max(F.when(F.col("key") == k, one)), empty).alias(k) for k in PARAMETER_KEYS])


def decision_variables(constraints: DataFrame, parameters: DataFrame) -> DataFrame:
    """entity, category, name, symbol, unit, lower, upper: one row per category with a definition, in definition order."""
    spark = constraints.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, *v) for i, v in enumerate(fixed.VARIABLES)], "rank int, v_category string, v_name string, symbol string, v_unit string"))
    seen = constraints.select("entity", "category").distinct().join(table, F.col("category") == F.col("v_category"))
    rows = seen.join(bounds(constraints), ["entity", "category"], "left").join(parameters, ["entity"], "left")
    level = F.col("category") == "water_level"
    lower = F.coalesce("lower", F.when(level, F.col("dead_storage_level.value")))
    upper = F.coalesce("upper", F.when(level, F.coalesce("flood_control_level.value", "normal_storage_level.value")))
    return rows.select("entity", "category", F.col("v_name").alias("name"), "symbol", F.col("v_unit").alias("unit"), lower.alias("lower"), upper.alias("upper"), "rank")


def objective_candidates(constraints: DataFrame) -> DataFrame:
    """entity, description, direction: by the category of the entity's constraints."""
    table = F.broadcast(constraints.sparkSession.createDataFrame(fixed.OBJECTIVES, "o_category string, description string, direction string"))
    return constraints.join(table, F.col("category") == F.col("o_category")).select("entity", "description", "direction").distinct()


def time_series(series: DataFrame) -> DataFrame:
    """entity, entries (by year), count."""
    entry = F.struct("year", F.col("year").cast("string").alias("label"), "indicator", "value", "unit")
    return series.groupBy("entity").agg(F.array_sort(F.collect_list(entry)).alias("entries")).withColumn("count", F.size("entries"))


def dispatch_rules(rows: DataFrame) -> DataFrame:
    """entity and a list of rules with name, content, period, condition and provenance."""
    rule = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "content", "applicable_period", "condition", "source_doc")], "confidence")
    return rows.groupBy("entity").agg(F.array_sort(F.collect_list(rule)).alias("dispatch_rules"))


def formulate(entities: DataFrame, constraints: DataFrame, parameters: DataFrame, series: DataFrame | None = None, rule_rows: DataFrame | None = None) -> DataFrame:
    """One nested row per entity (id, name); an entity without data gets empty lists."""
    nest = lambda df, cols, out: df.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(out))
    parts = [
        nest(constraints, ["id", "name", "expression", "category", "variable", "operator", "value", "unit"], "constraints"),
        nest(decision_variables(constraints, parameters), ["rank", "name", "symbol", "unit", "lower", "upper"], "decision_variables"),
        nest(objective_candidates(constraints), ["description", "direction"], "objective_candidates"),
        parameters.select("entity", F.struct(*PARAMETER_KEYS).alias("parameters")),
    ]
    parts += [time_series(series).select("entity", F.struct("entries", "count").alias("time_series"))] if series is not None else []
    parts += [dispatch_rules(rule_rows)] if rule_rows is not None else []
    out = entities.select(F.col("id").alias("entity"), F.struct("id", "name").alias("problem_meta"))
    for part in parts:
        out = out.join(part, ["entity"], "left")
    for name in ("constraints", "decision_variables", "objective_candidates"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out


def solver_ready(entities: DataFrame, constraints: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variables, constraints) with symbols numbered by the entities' order (column ord, from 1).

    Only constraints with a real operator and a value are emitted; dead and flood levels of the parameters are added.
    """
    who = entities.select(F.col("id").alias("entity"), F.col("name").alias("who"), F.col("ord").alias("number"))
    variables = decision_variables(constraints, parameters).join(who, "entity")
    tag = F.concat(F.col("symbol"), F.lit("_"), F.col("number").cast("string"))
    variables = variables.select(tag.alias("symbol"), F.concat_ws("_", "who", "name").alias("name"), "lower", "upper", "unit")
    symbols = {c: s for c, _, s, _ in fixed.VARIABLES}
    symbol = F.create_map(*[F.lit(x) for kv in symbols.items() for x in kv])[F.col("category")]
    rows = constraints.join(who, "entity").where(F.col("operator").isin("<=", ">=", "==") & F.col("value").isNotNull() & F.col("category").isin(list(symbols)))
    expression = F.concat_ws(" ", F.concat(symbol, F.lit("_"), F.col("number").cast("string")), "operator", F.col("value").cast("string"), F.nullif("unit", F.lit("")))
    listed = rows.select(expression.alias("expression"), F.col("category").alias("type"), F.col("name").alias("description"))
    levels = parameters.join(who, "entity")
    for key, sign in (("dead_storage_level", ">="), ("flood_control_level", "<=")):
        text = F.concat(F.lit("Z_"), F.col("number").cast("string"), F.lit(f" {sign} "), F.col(f"{key}.value").cast("string"))
        listed = listed.unionByName(levels.where(F.col(f"{key}.value").isNotNull()).select(text.alias("expression"), F.lit("water_level").alias("type"), F.concat(F.col("who"), F.lit(f" {COMPARE_LABELS[key]}约束")).alias("description")))
    return variables, listed


def compare(entities: DataFrame, parameters: DataFrame, names: list[str]) -> DataFrame:
    """parameter label by entity name, with value and unit as text; the names to compare are given by the caller."""
    label = F.create_map(*[F.lit(x) for kv in COMPARE_LABELS.items() for x in kv])
    long = parameters.select("entity", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("p")) for k in PARAMETER_KEYS])).alias("x"))
    long = long.join(entities.select(F.col("id").alias("entity"), "name"), "entity").select(label[F.col("x.key")].alias("parameter"), "name", F.nullif(F.concat_ws("", F.col("x.p.value").cast("string"), F.col("x.p.unit")), F.lit("")).alias("shown"))
    return long.groupBy("parameter").pivot("name", names).agg(F.max("shown"))


def objective_hints(constraints: DataFrame) -> DataFrame:
    """hint: direction and description of every objective candidate of any entity, each once."""
    return objective_candidates(constraints).select(F.concat_ws("_", "direction", "description").alias("hint")).distinct()


def solver_series(entities: DataFrame, series: DataFrame) -> DataFrame:
    """entity, name and time_series: indicator -> entries (year, value, unit) in year order."""
    entry = F.struct("year", "value", "unit")
    rows = series.groupBy("entity", F.coalesce("indicator", F.lit("unknown")).alias("indicator")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    rows = rows.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator", "entries")))).alias("time_series"))
    return rows.join(entities.select(F.col("id").alias("of"), "name"), F.col("entity") == F.col("of")).select("entity", "name", "time_series")


def solver_document(entities: DataFrame, constraints: DataFrame, parameters: DataFrame, series: DataFrame | None = None, year: int | None = None) -> DataFrame:
    """One row in the form a solver takes: variables, constraints, time_series by entity and indicator, hints and meta.

    Series are included if a year is asked for, as published; ``entities`` is a short list given by the caller.
    """
    variables, listed = solver_ready(entities, constraints, parameters)
    gather = lambda df, cols, name: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = gather(variables, ["symbol", "name", "lower", "upper", "unit"], "variables").join(gather(listed, ["expression", "type", "description"], "constraints"))
    chosen = solver_series(entities, series) if series is not None and year is not None else None
    kind = "map<string,map<string,array<struct<year:int,value:string,unit:string>>>>"
    if chosen is None:
        out = out.withColumn("time_series", F.create_map().cast(kind))
    else:
        out = out.join(chosen.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), F.map_entries("time_series").alias("e"))))).alias("m")))
        out = out.withColumn("time_series", F.transform_values("m", lambda _, e: F.map_from_entries(e)).cast(kind)).drop("m")
    out = out.join(objective_hints(constraints).agg(F.array_sort(F.collect_list("hint")).alias("objective_hints")))
    meta = F.struct(F.col("n").alias("reservoir_count"), F.size("constraints").alias("constraint_count"), F.array(*[F.lit(year)] * (year is not None)).cast("array<int>").alias("time_series_years"))
    return out.join(entities.agg(F.count("*").alias("n"))).withColumn("meta", meta).drop("n")
