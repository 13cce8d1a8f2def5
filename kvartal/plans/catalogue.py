"""Imports every module that registers queries."""

from kvartal.plans import base, city, layers, moving, packages, people, places, space, time  # noqa: F401
