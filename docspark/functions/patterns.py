"""Regular expressions as Spark runs them: Java's, unanchored, with Unicode classes. They are compiled once on the driver, so that no job fails by one."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


def compiled(pattern: str):  # noqa: ANN201
    """The pattern compiled by the JVM, or None if it can't be."""
    try:
        return SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return None


def unicode(pattern: str, flags: str = "") -> str:
    """A pattern whose classes such as ``\\w`` and ``\\b`` are those of Unicode, with more flags."""
    return f"(?U{flags}){pattern}"


def found(pattern: str, text: str) -> bool:
    """Whether a pattern that compiles is found in a text of the driver."""
    return compiled(pattern).matcher(text).find()
