"""Errors that operators raise, with the exit code of each kind."""

from __future__ import annotations


class SiftworkError(Exception):
    exit_code = 1


class UserInputError(SiftworkError):
    exit_code = 2


class DataIntegrityError(SiftworkError):
    exit_code = 3


class LeakageError(DataIntegrityError):
    pass


class PolicyError(DataIntegrityError):
    pass


class MetricPartitionError(SiftworkError):
    exit_code = 4
