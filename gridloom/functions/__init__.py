"""Column functions of the engine, importable on their own."""

from ..operators.local import accumulation_class, aspect_class, direction_class, log_transform, mask, order_class, ramp_position, reclassify, safe_divide, slope_class, watershed_hue
from ..operators.vector import length_of
from ..sources.grids import cell_of, no_data

__all__ = ["accumulation_class", "aspect_class", "cell_of", "direction_class", "length_of", "log_transform", "mask", "no_data", "order_class", "ramp_position", "reclassify", "safe_divide", "slope_class", "watershed_hue"]
