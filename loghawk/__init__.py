"""loghawk: security-log scoring and analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame (+ parameters) -> DataFrame``.
Nothing is collected to the driver on a data path; global scalars
(medians, quartiles, the busiest source, min/max) are one-row frames joined
back with a broadcast, whose size is bounded by construction.
"""

__version__ = "0.1.0"
