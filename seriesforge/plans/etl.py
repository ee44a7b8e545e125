"""Bulk file to fact and dimension tables.

The text of a bulk file is parsed once: the monthly records go to a columnar staging table, split by
family, and every output reads only the columns and the family it needs from there. A lost executor
costs its own tasks, since each stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesforge.operators.dims import (
    ELECTRICITY_FAMILIES, MISSED, Family, add_attributes, base_dimension, total_dimension, with_family,
)
from seriesforge.functions.clean import null_sentinels
from seriesforge.operators.facts import explode_history
from seriesforge.sources.bulk import ELECTRICITY_SCHEMA, TOTAL_SCHEMA, keep_frequency, read_bulk
from seriesforge.sources.sinks import Output, write_outputs, write_table

# Names of the output tables, below the output folder.
ELECTRICITY_TABLES = {
    "facts": "ElectricityFactDF",
    "power": "ElectricityPowerDimDF",
    "plant_level": "ElectricityPlantLevelDimDF",
    "retail": "ElectricityRetailDimDF",
    "fossil_fuel": "ElectricityFossilFuelDimDF",
    "fossil_fuel_quality": "ElectricityFossilFuelQualityDimDF",
    "missed": "ElectricityMissedDimDF",
}
TOTAL_TABLES = {"facts": "TotalEnergyFactDF", "dimensions": "TotalEnergyDimDF"}


def stage(raw: DataFrame, path: str, families: tuple[Family, ...] | None = None) -> DataFrame:
    """Write the monthly records as parquet, one folder per family if there are any, and read them back.

    There is no shuffle, so a large family stays spread over the tasks that read it.
    """
    spark, monthly = raw.sparkSession, keep_frequency(raw)
    if families:
        write_table(with_family(monthly, families), path, ["family"])
        schema = T.StructType([*raw.schema.fields, T.StructField("family", T.StringType())])
    else:
        write_table(monthly, path)
        schema = raw.schema
    return spark.read.schema(schema).parquet(path)


def electricity_outputs(staged: DataFrame, root: str, families: tuple[Family, ...] = ELECTRICITY_FAMILIES,
                        tables: dict[str, str] | None = None) -> list[Output]:
    """Facts, one dimension per family, and the series no family claims."""
    tables = tables or ELECTRICITY_TABLES
    outputs = [Output(explode_history(staged), "electricity_facts", f"{root}/{tables['facts']}")]
    for family in families:
        rows = staged.filter(F.col("family") == family.name).drop("family")
        dim = add_attributes(base_dimension(rows), family)
        outputs.append(Output(dim, f"electricity_{family.name}_dimensions", f"{root}/{tables[family.name]}"))
    rest = null_sentinels(base_dimension(staged.filter(F.col("family") == MISSED).drop("family")))
    outputs.append(Output(rest, "electricity_missed_dimensions", f"{root}/{tables[MISSED]}"))
    return outputs


def run_electricity(spark: SparkSession, source: str | list[str], root: str,
                    families: tuple[Family, ...] = ELECTRICITY_FAMILIES, plan_dir: str | None = None,
                    show_samples: bool = False, backup_root: str | None = None) -> list[str]:
    """Read an electricity bulk file and write its seven tables below ``root``."""
    raw = read_bulk(spark, source, ELECTRICITY_SCHEMA)
    outputs = electricity_outputs(stage(raw, f"{root}/Staged/Electricity", families), root, families)
    return write_outputs(outputs, plan_dir, show_samples, backup_root)


def run_total(spark: SparkSession, source: str | list[str], root: str, plan_dir: str | None = None,
              show_samples: bool = False, backup_root: str | None = None) -> list[str]:
    """Read a total bulk file and write its two tables below ``root``."""
    staged = stage(read_bulk(spark, source, TOTAL_SCHEMA), f"{root}/Staged/Total")
    outputs = [
        Output(total_dimension(staged), "total_dimensions", f"{root}/{TOTAL_TABLES['dimensions']}"),
        Output(explode_history(staged), "total_facts", f"{root}/{TOTAL_TABLES['facts']}"),
    ]
    return write_outputs(outputs, plan_dir, show_samples, backup_root)
