"""Published tables and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import close_to, spreadsheet_safe
from tidemark.sources.readers import flatten


def safe_for_spreadsheets(df: DataFrame) -> DataFrame:
    """Text columns that no spreadsheet runs; numbers stay."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: spreadsheet_safe(c) for c in text})


def publishable(df: DataFrame) -> DataFrame:
    """Structs flattened, arrays and maps as JSON text, text made safe."""
    flat = flatten(df)
    nested = {f.name: F.to_json(f.name) for f in flat.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType))}
    return safe_for_spreadsheets(flat.withColumns(nested) if nested else flat)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    publishable(df).write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by columns of few values such as a day."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def participant_items(categories: DataFrame) -> DataFrame:
    """An account's categories in order of turnover, with what its window average compares to."""
    turnover = F.coalesce("buy_value", F.lit(0.0)) + F.coalesce("sell_value", F.lit(0.0))
    order = Window.partitionBy("kind", "account").orderBy(F.desc(turnover), "category")
    return categories.withColumns({"item_index": F.row_number().over(order), "comparison_basis": F.lit("window averages; not realized P&L")})


def participant_rankings(boards: DataFrame) -> DataFrame:
    """Boards under their published names; an account without a known name goes by its id."""
    return boards.withColumnsRenamed({"board": "ranking_kind", "kind": "entity_kind", "account": "entity_id", "country_name": "citizenship_name"}).withColumn("name", F.coalesce("name", "entity_id"))


def action_costs(basket: DataFrame, costs: DataFrame, prices: DataFrame) -> DataFrame:
    """One row for each component that an action needs, beside the action's own cost."""
    rows = basket.join(prices, "item_code", "left").join(costs.select("action", "components", "priced", "coverage_pct", "cost"), "action")
    return rows.withColumns({
        "component_cost": F.col("amount") * F.col("price"), "component_status": F.when(F.col("price").isNull(), "missing").otherwise("available"),
        "availability_status": F.when(F.col("cost").isNull(), "unavailable").otherwise("available"),
    })


def stat_rows(sales: DataFrame, key: str = "id", stats: str = "stats") -> DataFrame:
    """One row for each stat of a sale."""
    return sales.select(key, F.explode(stats).alias("skill", "value"))


def inflation(definitions: DataFrame, levels: DataFrame, changes: DataFrame, periods: list[str]) -> DataFrame:
    """One row for each index, day and period that was compared, with why a number is missing.

    A day without any comparison has one row, an index without any level one for each period.
    """
    seen = definitions.join(levels, "index_key").join(changes.drop("coverage_pct"), ["index_key", "as_of"], "left")
    none = definitions.join(levels.select("index_key").distinct(), "index_key", "left_anti").withColumn("period_label", F.explode(F.array(*map(F.lit, periods))))
    rows = seen.unionByName(none, allowMissingColumns=True)
    status = F.when(F.col("as_of").isNull(), "definition_unavailable").when(F.col("level").isNull(), "level_unavailable").when(F.col("change_pct").isNull(), "comparison_unavailable").otherwise("available")
    return rows.withColumns({"classification": F.coalesce("class", F.lit("Insufficient data")), "availability_status": status}).drop("class")


def account_totals(published: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose published total is not the source's."""
    left = published.groupBy(*keys).agg(F.sum(value).alias("published"))
    right = source.groupBy(*keys).agg(F.sum(value).alias("source"))
    return left.join(right, keys, "full").where(~F.coalesce(close_to(F.col("published"), F.col("source")), F.lit(False)))


def differences(published: DataFrame, source: DataFrame) -> DataFrame:
    """Rows that only one of the two has; none if the publication is right."""
    columns = source.columns
    left, right = published.select(*columns), source.select(*columns)
    return left.exceptAll(right).withColumn("only_in", F.lit("published")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("source")))
