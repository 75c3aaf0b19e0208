"""Urban-graph analytics and training-data preparation as DataFrame operators."""
