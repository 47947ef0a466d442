"""turnlake — conversation-record analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s), options -> DataFrame``.
Nothing data-sized is collected to the driver; the only driver values are
parameters (a query vector, k centroids, a handful of prefix lengths).
"""

__version__ = "0.1.0"
