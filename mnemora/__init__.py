"""Associative graph memory, re-expressed as set-oriented Spark DataFrame operators."""

import importlib
import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

#: Public names by the module that has them; they are imported when first asked for.
_PUBLIC = {"MemoryEngine": "mnemora.engine", "GraphStore": "mnemora.sources.store", "ConcurrentWrite": "mnemora.sources.store", "RetrievalConfig": "mnemora.config"}
__all__ = sorted(_PUBLIC)

# Functions of this package travel to the executors with their code, so nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def __getattr__(name: str) -> object:
    if name in _PUBLIC:
        return getattr(importlib.import_module(_PUBLIC[name]), name)
    raise AttributeError(name)
