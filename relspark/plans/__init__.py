"""From syntax trees to DataFrames: binding and planning."""
