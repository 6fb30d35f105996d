"""Registered queries and their SQL oracles over tables derived from the given ones."""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FAMILIES = (
    "polygons",
    "bands",
    "metrics",
    "sources",
    "labels",
    "morphology",
    "splits",
    "jobs",
)


def load_all() -> None:
    """Import every family module; importing registers its queries."""
    for family in FAMILIES:
        importlib.import_module(f"catalog.{family}")
