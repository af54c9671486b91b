"""Two differently shaped registers of places brought into one shape and united.

One register is a CSV file with its own column names, the other JSON lines with
everything in a nested ``fields`` struct. Both become ``PLACES`` rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from tableloom.functions import composite_id, item, nested_fields, split_item
from tableloom.operators import conform, spread, union_by_name

# The columns of the common shape. Both sides are cast to its types,
# so types inferred for the two files need not agree.
PLACES = StructType(
    [
        StructField("id", StringType()),
        StructField("datasetId", StringType()),
        StructField("name", StringType()),
        StructField("address1", StringType()),
        StructField("address2", StringType()),
        StructField("city", StringType()),
        StructField("state", StringType()),
        StructField("zip", StringType()),
        StructField("tel", StringType()),
        StructField("dateStart", DateType()),
        StructField("dateEnd", DateType()),
        StructField("type", StringType()),
        StructField("geoX", DoubleType()),
        StructField("geoY", DoubleType()),
        StructField("county", StringType()),
    ]
)


def from_flat(
    df: DataFrame,
    county: str,
    rename: Mapping[str, str],
    target: StructType = PLACES,
    partitions: int | None = None,
) -> DataFrame:
    """A flat register: columns renamed, county and id added, the rest dropped or NULL.

    ``partitions`` deals the rows out evenly, for a register in few files.
    """
    places = conform(
        df,
        rename=rename,
        constants={"county": county},
        derive={"id": composite_id("state", "county", "datasetId")},
        target=target,
    )
    return places if partitions is None else spread(places, partitions)


def from_nested(
    df: DataFrame,
    county: str,
    fields: Mapping[str, str],
    *,
    struct: str = "fields",
    type_field: str = "type_description",
    location_field: str = "geolocation",
    target: StructType = PLACES,
) -> DataFrame:
    """A nested register: fields lifted out of the struct.

    The type is the part after " - " in its description, the coordinates the first
    two items of the location array; both are NULL where there is no such part.
    """
    lifted = conform(
        df,
        constants={"county": county},
        derive={
            **nested_fields(struct, fields),
            "type": split_item(f"{struct}.{type_field}", " - ", 1),
            "geoX": item(f"{struct}.{location_field}", 0),
            "geoY": item(f"{struct}.{location_field}", 1),
        },
    )
    return conform(
        lifted,
        derive={"id": composite_id("state", "county", "datasetId")},
        target=target,
    )


def county_union(flat: DataFrame, nested: DataFrame) -> DataFrame:
    """All places of both registers."""
    return union_by_name(flat, nested)
