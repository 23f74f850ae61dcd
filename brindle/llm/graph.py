"""Connected components as a Spark job."""

from brindle.operators.graph import components  # noqa: F401
