"""Connected components, which the graph's operators share."""

from quernstone.operators.components import components, hook_step

__all__ = ["components", "hook_step"]
