"""Connected components of a table of links."""

from ..operators.graph import are_stars, components, star

__all__ = ["are_stars", "components", "star"]
