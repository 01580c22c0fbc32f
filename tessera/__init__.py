"""tessera: exploration, preparation, splitting and modelling operators on Spark DataFrames.

Every operator is a plain ``DataFrame -> DataFrame`` function (or a small driver-side object
holding literals learned by one aggregate).  Planning and execution are left to Catalyst/AQE.
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
