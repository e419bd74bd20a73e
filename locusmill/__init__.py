"""locusmill: annotated genomes and biological sequences as Spark DataFrames.

The core tables are plain DataFrames (see ``locusmill.model``); every operator
takes and returns DataFrames, so results can be cached, joined and written with
ordinary Spark calls.
"""

__version__ = "0.1.0"
