"""Physical layouts of gold (clustered, bucketed) and plan reports."""
