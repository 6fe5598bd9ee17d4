"""Operators for preparing training text; nothing else in the library imports this."""

from pyspark import cloudpickle

import corpuslens

# Functions of this package travel to the executors by value, so a cluster needs no
# installed copy of it.
cloudpickle.register_pickle_by_value(corpuslens)
