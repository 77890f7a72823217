"""Operators of a training-data pipeline.

Nothing outside this package imports it. Each module holds one operator as a
function from DataFrame to DataFrame; ``queries`` binds them to the tables.

Conventions shared by all of them:

* rows are named by the integer ``doc_id`` (``vec_id`` for vectors), which may
  be null or repeated; a null name is an ordinary value that orders last;
* a null text is a document without content; each operator's docstring gives
  its result for null, empty and repeated rows;
* only the columns an operator needs are read, so further columns never clash;
  operators that pass whole rows through use helper names that are free in the
  input.
"""
