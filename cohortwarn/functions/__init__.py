from cohortwarn.functions.codes import canonical_code, course_is, course_prefix, course_startswith
from cohortwarn.functions.grades import (
    GRADE_ORDER,
    NO_GRADE,
    PASS_GRADES,
    encode_label,
    grade_binary,
    grade_points,
    pass_fail,
)
from cohortwarn.functions.numbers import (
    coerce_number,
    finite_or_null,
    hash_hex,
    hash_unit,
    parse_day,
    percent_value,
    ratio,
    strict_int,
)

__all__ = [
    "GRADE_ORDER", "NO_GRADE", "PASS_GRADES", "canonical_code", "coerce_number", "course_is",
    "course_prefix", "course_startswith", "encode_label", "finite_or_null", "grade_binary",
    "grade_points", "hash_hex", "hash_unit", "parse_day", "pass_fail", "percent_value", "ratio",
    "strict_int",
]
