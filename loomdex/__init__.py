"""loomdex: a PySpark-native knowledge-base engine.

Heterogeneous developer artefacts are normalised to one ``documents`` model, enriched, indexed and
queried with DataFrame plans only; see README.md for the operator catalogue.
"""

__version__ = "0.1.0"
