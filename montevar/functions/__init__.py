from montevar.functions.numeric import (keyed_normal, keyed_uniform, poisson1_from_uniform,
                                       round3, round_half_away)
from montevar.functions.parsing import nan_to_null, parse_date_text, parse_number_text

__all__ = ["keyed_normal", "keyed_uniform", "poisson1_from_uniform", "round3",
           "round_half_away", "nan_to_null", "parse_date_text", "parse_number_text"]
