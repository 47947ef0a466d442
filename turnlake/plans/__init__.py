"""Named query plans over the driver tables (the registry behind ``__spark_entry__``)."""
