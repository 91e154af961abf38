"""Connected components, which the engine outside the text-corpus operators uses as well."""

from tidewell.graph import components

__all__ = ["components"]
