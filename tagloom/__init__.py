"""tagloom: Spark jobs for building, cleaning, querying and exporting tag-caption datasets.

A dataset is a DataFrame with one row per record and a unique ``image_key``.  A caption is an
``array<string>`` column (``tags``), ordered and with duplicates allowed.  Column functions live in
``functions``; table operators take DataFrames and return DataFrames and live in ``operators``.
"""

__version__ = "0.1.0"
