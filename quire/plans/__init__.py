"""Named queries over the data folder and the SQL they are checked against."""
