"""Connected components, as the rest of the library finds them."""

from quillspark.operators.components import components

__all__ = ["components"]
