"""Routing series to families by id prefix, and the attributes each family carries in its names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.clean import null_sentinels, to_double, to_int, to_stamp
from seriesforge.functions.names import name_part, plant_number, starts_with_any


@dataclass(frozen=True)
class Family:
    """Series whose id starts with one of ``prefixes``; ``parts`` names the parts of the series name."""

    name: str
    prefixes: tuple[str, ...]
    parts: tuple[str, ...]
    plant_id: bool = False

    def holds(self, series_id: Column | str = "series_id") -> Column:
        return starts_with_any(series_id, list(self.prefixes))

    @property
    def attributes(self) -> tuple[str, ...]:
        return self.parts + (("plant_id",) if self.plant_id else ())


# Id prefixes and name parts of the electricity families.
ELECTRICITY_FAMILIES = (
    Family(
        "power",
        ("ELEC.GEN.", "ELEC.CONS_TOT.", "ELEC.CONS_TOT_BTU.", "ELEC.CONS_EG.", "ELEC.CONS_EG_BTU.",
         "ELEC.CONS_UTO.", "ELEC.CONS_UTO_BTU."),
        ("value_type", "fuel_type", "region", "sector", "frequency"),
    ),
    Family(
        "plant_level",
        ("ELEC.PLANT.GEN.", "ELEC.PLANT.CONS_TOT.", "ELEC.PLANT.CONS_TOT_BTU.", "ELEC.PLANT.CONS_EG.",
         "ELEC.PLANT.CONS_EG_BTU.", "ELEC.PLANT.CONS_UTO.", "ELEC.PLANT.CONS_UTO_BTU.",
         "ELEC.PLANT.AVG_HEAT."),
        ("value_type", "plant_name", "fuel_type", "engine_type", "frequency"),
        plant_id=True,
    ),
    Family(
        "retail",
        ("ELEC.SALES.", "ELEC.REV.", "ELEC.PRICE.", "ELEC.CUSTOMERS."),
        ("value_type", "region", "sector", "frequency"),
    ),
    Family(
        "fossil_fuel",
        ("ELEC.STOCKS.", "ELEC.RECEIPTS.", "ELEC.RECEIPTS_BTU.", "ELEC.COST.", "ELEC.COST_BTU."),
        ("value_type", "fuel_type", "region", "sector", "frequency"),
    ),
    Family(
        "fossil_fuel_quality",
        ("ELEC.SULFUR_CONTENT.", "ELEC.ASH_CONTENT."),
        ("value_type", "quality_type", "fuel_type", "region", "sector", "frequency"),
    ),
)
MISSED = "missed"


def family_of(families: tuple[Family, ...], series_id: Column | str = "series_id") -> Column:
    """Name of the family of a series id, ``missed`` when none claims it."""
    route = F.when(families[0].holds(series_id), families[0].name)
    for family in families[1:]:
        route = route.when(family.holds(series_id), family.name)
    return route.otherwise(MISSED)


def with_family(raw: DataFrame, families: tuple[Family, ...] = ELECTRICITY_FAMILIES) -> DataFrame:
    return raw.withColumn("family", family_of(families))


def base_dimension(raw: DataFrame) -> DataFrame:
    """Descriptive columns shared by all electricity families, typed. The history is not read."""
    return raw.drop("data", "latlon").withColumns({
        "last_updated": to_stamp("last_updated"),
        "lat": to_double("lat"),
        "lon": to_double("lon"),
        "start": to_int("start"),
        "end": to_int("end"),
    })


def family_dimension(raw: DataFrame, family: Family) -> DataFrame:
    """Dimension table of one family."""
    return add_attributes(base_dimension(raw.filter(family.holds())), family)


def add_attributes(base: DataFrame, family: Family) -> DataFrame:
    columns = {part: name_part("name", i) for i, part in enumerate(family.parts)}
    if family.plant_id:
        columns["plant_id"] = plant_number("series_id")
    return null_sentinels(base.withColumns(columns))


def all_dimensions(raw: DataFrame, families: tuple[Family, ...] = ELECTRICITY_FAMILIES) -> DataFrame:
    """Every family in one pass over the records: base columns, ``family``, and each attribute any family
    has, NULL where the series' own family does not have it."""
    rows = with_family(base_dimension(raw), families)
    columns: dict[str, Column] = {}
    for name in dict.fromkeys(a for family in families for a in family.parts):
        holders = [(f, f.parts.index(name)) for f in families if name in f.parts]
        value = F.when(F.col("family") == holders[0][0].name, name_part("name", holders[0][1]))
        for family, position in holders[1:]:
            value = value.when(F.col("family") == family.name, name_part("name", position))
        columns[name] = value
    plants = [f.name for f in families if f.plant_id]
    if plants:
        columns["plant_id"] = F.when(F.col("family").isin(*plants), plant_number("series_id"))
    return null_sentinels(rows.withColumns(columns))


def missed_dimension(raw: DataFrame, families: tuple[Family, ...] = ELECTRICITY_FAMILIES) -> DataFrame:
    """Series no family claims: the completeness check of the routing."""
    return null_sentinels(base_dimension(raw.filter(family_of(families) == MISSED)))


def total_dimension(raw: DataFrame) -> DataFrame:
    """Dimension of the total layout: start and end stay text, ``childseries`` passes through."""
    return null_sentinels(raw.drop("data").withColumn("last_updated", to_stamp("last_updated")))
