"""Compositions of operators: matching runs, previews and the registered queries."""
