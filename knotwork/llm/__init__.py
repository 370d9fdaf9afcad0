"""Operators for preparing language-model training data.

The rest of the library does not import this subpackage. Unless a docstring
says otherwise, rows without a ``doc_id`` are left out (they can't be named in
a result), a null text counts as the empty text, and columns other than
``doc_id`` and ``text`` are ignored whatever their names.
"""
