"""Fitted transforms are projections and lookups, so a streaming frame passes through them unchanged.

There is nothing else here: every statistic is fitted on batch data, no operator
keeps streaming state.
"""
