"""Operators for preparing training text: packing, deduplication, filters, scans, scoring, formats, tries, phrases, token files."""

from pyspark import cloudpickle

import gradeloom

# Ship this package inside the task closure, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(gradeloom)
