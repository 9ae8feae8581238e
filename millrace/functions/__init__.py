"""Column expressions of the algebra."""

from millrace.functions.expr import bit_range, cast_to, int_div, int_pow, log2_up, not_equal, pow2
from millrace.functions.hashing import hash64
from millrace.functions.host import host_function
from millrace.functions.lists import fill, prefix_sum, rotate_left, rotate_right

__all__ = ["bit_range", "cast_to", "fill", "hash64", "host_function", "int_div", "int_pow", "log2_up", "not_equal", "pow2", "prefix_sum", "rotate_left", "rotate_right"]
