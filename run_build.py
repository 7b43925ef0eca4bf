"""spark-submit launcher for the table build from landed files.

    zip -r thermoload.zip thermoload
    spark-submit --py-files thermoload.zip run_build.py --weather ... --load-pages ... \
        --facilities ... --out ...
"""

from thermoload.plans.run import main

if __name__ == "__main__":
    main()
