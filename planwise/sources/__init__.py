"""Sources and sinks: delimited files, workbooks, SQL, snapshots, samples."""
