"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame, names its id and text columns as parameters, and returns a
DataFrame; all other columns of the input are ignored, so extra or clashing
names do no harm.  A null text counts as the empty text unless the operator's
docstring says otherwise; an empty table gives an empty result with the same
schema; repeated rows give repeated result rows.
"""
