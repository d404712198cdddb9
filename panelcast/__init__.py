"""panelcast: demand and sales time-series analytics on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames (or dicts of
them). A panel has the columns ``series_id, ds, y``: one row per series and
period. Series, cross-validation fold, model and hyper-parameter candidate are
ordinary grouping columns, so one Spark job works on all of them at once.
"""
