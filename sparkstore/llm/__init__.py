"""Operators for preparing training text at scale.

Each module holds one operator with a general interface; ``queries`` derives the
registered ``opN_<name>`` results from them. Nothing outside this subpackage
imports it.
"""
