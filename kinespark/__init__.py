"""kinespark: DataFrame operators for keypoint and marker trajectories.

Every operator takes and returns DataFrames and treats the trial as a grouping
column, so one job covers all subjects, trials and cameras. Ordered work inside
a trial is cut into bounded time blocks (see ``operators.series``), so a single
very long trial spreads over the whole cluster.
"""

from kinespark.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
