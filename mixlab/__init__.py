"""mixlab: corpus, mixture and evaluation jobs expressed as Spark DataFrame plans.

Every public operator is a function ``DataFrame -> DataFrame`` (plus
parameters). Nothing is collected to the driver; per-row logic lives in
built-in column expressions so that it stays inside whole-stage codegen.
"""

__version__ = "0.1.0"
