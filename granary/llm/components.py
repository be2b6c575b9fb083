"""Connected components of links between documents."""

from __future__ import annotations

from ..operators.components import connected_components  # noqa: F401
