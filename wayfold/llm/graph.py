"""Connected components: the library's own, for edge lists whose nodes have no layout."""

from wayfold.operators.components import star_components as components

__all__ = ["components"]
