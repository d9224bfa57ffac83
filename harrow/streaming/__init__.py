"""Row-wise operators on file streams."""
