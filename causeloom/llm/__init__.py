"""Operators for preparing language-model training data.

Nothing outside this package imports it.  Each module holds one operator with
its general interface; :mod:`causeloom.llm.registry` derives the registered
``opN_<name>`` queries and their SQL from those operators.
"""
