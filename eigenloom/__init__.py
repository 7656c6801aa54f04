"""Unsupervised multi-level subspace features for tables of images and vectors, on Spark."""

import sys

from pyspark import cloudpickle

from .plans.estimator import SubspaceEstimator, SubspaceModel
from .sources.models import load_model, save_model
from .spec import HopSpec

# The task functions travel with the job, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["HopSpec", "SubspaceEstimator", "SubspaceModel", "load_model", "save_model"]
