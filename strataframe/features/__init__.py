"""Feature rows per series position and labelled training rows."""
