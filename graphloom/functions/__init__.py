"""Column functions that the operators are made of, for use in one's own queries."""

from ..operators.core import floor_divide, ieee_divide, keyed_bits, keyed_uniform
from ..operators.randomness import randint, randreal
from ..operators.spatial import cosine_distance, squared_distance

__all__ = ["cosine_distance", "floor_divide", "ieee_divide", "keyed_bits", "keyed_uniform", "randint", "randreal", "squared_distance"]
