"""Column functions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Private ranges by prefix; bands of the first octet (below the bound) and where they lie.
PRIVATE = r"^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[0-1])\.|^127\."
BANDS = ((64, "United States", "Ashburn", 39.0438, -77.4874), (128, "Germany", "Frankfurt", 50.1109, 8.6821), (192, "Singapore", "Singapore", 1.3521, 103.8198))
BEYOND = ("Australia", "Sydney", -33.8688, 151.2093)


def is_private_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(PRIVATE), F.lit(False))


def geo_band(ip: Column) -> Column:
    """Which of PLACES an address lies in; null for null and empty. A first part that is no number lies beyond all bands."""
    first = F.nullif(F.trim(F.split_part(ip, F.lit("."), F.lit(1))), F.lit(""))
    octet = F.when(first.isNull(), F.lit(0.0)).otherwise(first.try_cast("double"))
    width = BANDS[0][0]  # bands are equally wide; what is no number is skipped by least, and not-a-number the largest of all
    band = 1 + F.floor(F.greatest(F.lit(0.0), F.least(octet, F.lit(float(width * len(BANDS))))) / width)
    return F.when(F.nullif(ip, F.lit("")).isNull(), None).when(is_private_ip(ip), 0).otherwise(band.cast("int"))


#: scope, country, city, latitude and longitude of each band, private addresses first.
PLACES = (("private", "internal", "internal", None, None), *[("public", *where) for _, *where in BANDS], ("public", *BEYOND))


def geo_lookup(ip: Column, band: Column | None = None) -> Column:
    """struct<ip, scope, country, city, latitude, longitude>; null for null and empty. `band` is geo_band(ip), where it is a column already: each field needs it."""
    band = geo_band(ip) if band is None else band
    kinds = {"scope": "string", "country": "string", "city": "string", "latitude": "double", "longitude": "double"}
    fields = [F.get(F.array(*[F.lit(place[i]).cast(kind) for place in PLACES]), band).alias(name) for i, (name, kind) in enumerate(kinds.items())]
    return F.when(band.isNotNull(), F.struct(ip.alias("ip"), *fields))
