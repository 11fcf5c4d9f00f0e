"""Operators for building training corpora: filters, scoring, tokenisation and de-duplication.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` applies them to the tables with production parameters.
"""
