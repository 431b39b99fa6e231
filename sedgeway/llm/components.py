"""Connected components, as the text operators use them."""

from sedgeway.operators.components import connected_components

__all__ = ["connected_components"]
