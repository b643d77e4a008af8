"""HTML text as a stream of texts and tags: the library's scanner, under the name that this subpackage's operators use."""

from pagewarden.sources.markup import attributes, scan

__all__ = ["attributes", "scan"]
