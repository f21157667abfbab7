"""DataFrame-to-DataFrame operators, shared by batch jobs and micro-batches."""
