"""Column-level building blocks."""

from .parsing import parse_bracket, parse_json, parse_logfmt, parse_simple, parse_text, parse_ts
from .text import (age_label, clean_line, display_line, fingerprint, health, is_signal,
                   level_weight, source_name, strip, truncate)

__all__ = ["age_label", "clean_line", "display_line", "fingerprint", "health", "is_signal",
           "level_weight", "parse_bracket", "parse_json", "parse_logfmt", "parse_simple",
           "parse_text", "parse_ts", "source_name", "strip", "truncate"]
