"""revlens: CRM and marketing analytics as Spark DataFrame jobs.

Staging and cleaning of raw CRM tables, multi-touch revenue attribution,
channel influence, lead funnels, acquisition cost and lifetime value.
Every operator is a function from DataFrames to a DataFrame; nothing is
collected to the driver.
"""

from revlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
