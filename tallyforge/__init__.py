"""Spark-first analytics over semi-structured priced documents.

Every public function takes DataFrames and returns DataFrames; nothing runs
until the caller asks for an action.
"""
