"""End-to-end plans: observation runs, jobs, planning, registered test-data queries."""
