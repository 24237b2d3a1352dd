"""Column-expression builders (JVM-side, codegen friendly)."""

from vigil.functions.core import clip, nan_to_null, safe_div, to_double
from vigil.functions.series import Series

__all__ = ["Series", "clip", "nan_to_null", "safe_div", "to_double"]
