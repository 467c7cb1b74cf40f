"""Views over the driver tables and the queries built on them."""
