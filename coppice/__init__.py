"""Coppice: prepare, model, score and evaluate tables of any size with PySpark.

Every operator takes and returns DataFrames. Fitting runs bounded aggregates;
transforming, scoring and evaluating stay one lazy plan from scan to sink.
"""

from coppice.plans.model import Trained, TrainParams, predict, train
from coppice.plans.roles import Roles

__all__ = ["Roles", "TrainParams", "Trained", "predict", "train"]
