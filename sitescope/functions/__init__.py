"""Column -> Column functions (all JVM-side built-in expressions, no UDFs)."""

from .numeric import clip, coerce_double, coerce_typed, nan_to_null, np_round  # noqa: F401
from .features import (  # noqa: F401
    annualise_rainfall, elevation_zone, ndvi, soil_moisture, temperature, zone_name,
)
from .soil import decode_soil, encode_soil_lenient, encode_soil_strict, soil_error  # noqa: F401
from .text import title_case  # noqa: F401
from .rules import condition_array, rule_label, rule_score  # noqa: F401
from .labels import class_label, confidence_tier, confidence_color, gap_band  # noqa: F401
from .aggregates import exact_mean, exact_sum  # noqa: F401
from .hashing import unit_hash, unit_hash_int  # noqa: F401
